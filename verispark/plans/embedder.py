"""The plug-in slot for embedding models."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FALLBACK_THRESHOLD, VerifyConfig


class Embedder:
    """What a model must offer; embed() gives a vector or an exception for each image."""

    name = "base"
    model_name = ""
    default_threshold = FALLBACK_THRESHOLD

    def embed(self, images: list[bytes]) -> list[list[float] | Exception]:
        raise NotImplementedError


_factories: dict[str, Callable[..., Embedder]] = {}
_instances: dict[str, Embedder] = {}


def register(name: str, factory: Callable[..., Embedder]) -> None:
    """Make a model known; a second registration replaces the first and its instance."""
    if not callable(factory):
        raise TypeError("an embedder's factory must be callable")
    _factories[name] = factory
    _instances.pop(name, None)


def available() -> list[str]:
    """Registered names."""
    return sorted(_factories)


def factory_of(cfg: VerifyConfig) -> Callable[..., Embedder]:
    """The configured model's factory."""
    if cfg.provider not in _factories:
        raise ValueError(f"unknown embedder {cfg.provider!r}; available: {', '.join(available()) or 'none'}")
    return _factories[cfg.provider]


def get(cfg: VerifyConfig) -> Embedder:
    """The configured model, made once."""
    factory = factory_of(cfg)
    if cfg.provider not in _instances:
        made = factory(**cfg.provider_config)
        if not isinstance(made, Embedder):
            raise TypeError(f"{cfg.provider!r} doesn't make an Embedder")
        _instances[cfg.provider] = made
    return _instances[cfg.provider]


def default_threshold(cfg: VerifyConfig) -> float:
    """The configured model's own threshold, without making the model where its class tells."""
    factory = factory_of(cfg)
    return factory.default_threshold if isinstance(factory, type) and issubclass(factory, Embedder) else get(cfg).default_threshold


_workers: dict[tuple[str, str], Embedder] = {}


def embed(content: Column, cfg: VerifyConfig) -> Column:
    """struct<embedding, error> of image bytes; a bad image is an error, a null one stays null.

    A worker makes the model once and feeds it Arrow batches.
    """
    factory, key, options = factory_of(cfg), (cfg.provider, cfg.snapshot), cfg.provider_config

    @F.arrow_udf("struct<embedding: array<double>, error: string>")
    def run(images: pa.Array) -> pa.Array:
        if key not in _workers:
            _workers[key] = factory(**options)
        data = images.to_pylist()
        given = [k for k, x in enumerate(data) if x is not None]
        try:
            found = _workers[key].embed([data[k] for k in given])
        except Exception as problem:  # noqa: BLE001  a model that fails as a whole fails every image of the batch
            found = [problem] * len(given)
        vectors, errors = [None] * len(data), [None] * len(data)
        for k, v in zip(given, found):
            if isinstance(v, Exception):
                errors[k] = str(v) or type(v).__name__
            else:
                vectors[k] = [float(x) for x in v]
        return pa.StructArray.from_arrays([pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=["embedding", "error"])

    return run(content)
