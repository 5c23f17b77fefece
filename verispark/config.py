"""Settings of a verification run."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

#: Distance threshold where nothing is configured.
FALLBACK_THRESHOLD = 0.68


@dataclass(frozen=True)
class VerifyConfig:
    """What the operators need to know; defaults as in a fresh installation."""

    provider: str = "deepface"
    model_name: str = "ArcFace"
    provider_config: dict = field(default_factory=lambda: {"detector_backend": "retinaface", "enforce_detection": True})
    similarity_threshold: float | None = 0.68
    sampling_seconds: float = 5.0
    store_embeddings: bool = True

    @property
    def threshold(self) -> float:
        """The configured threshold; 0 and null mean the fallback."""
        return self.similarity_threshold or FALLBACK_THRESHOLD

    @property
    def snapshot(self) -> str:
        """What an embedding depends on, as canonical JSON; provider_config wins over the two names."""
        return json.dumps({"model_name": self.model_name, "provider": self.provider} | self.provider_config, sort_keys=True, separators=(",", ":"))


#: Length of each model's embeddings, by name.
EMBEDDING_SIZES = {"ArcFace": 512, "Buffalo_L": 512, "DeepFace": 4096, "DeepID": 160, "Dlib": 128, "Facenet": 128, "Facenet512": 512, "GhostFaceNet": 512, "OpenFace": 128, "SFace": 128, "VGG-Face": 2622}
