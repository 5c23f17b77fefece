"""Encoding of whole texts with a public tokenizer file, inside Arrow batches.

A byte-level BPE never joins text across the place where a space follows a non-space, nor where
letters, digits and marks meet. So a batch of texts is cut at its single spaces, its distinct words
are cut where those classes meet, distinct pieces are encoded once, and the ids are gathered back
in text order, all on Arrow arrays. Pieces stay in a bounded table for later batches. Texts where a
cut isn't safe (a space beside white space, special tokens, U+0000) are encoded whole.
"""

from __future__ import annotations

import os
import threading

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of the table of encoded pieces in each Python worker: some 60 bytes each.
MEMO_ENTRIES = 700_000
#: Pieces that are encoded as one text.
JOIN_PIECES = 400
#: Id written after each document.
END_ID = 2
END = np.array([END_ID], "<u4").tobytes()
#: Stands before a text's first piece, which has no space before it; two of them after a text are the end id.
_HEAD = "\x00"
#: A byte-level BPE writes bytes as characters: printable Latin-1 as itself, the others from 256 on, in order.
_OTHERS = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)]
_BYTE_CHARS = np.arange(256, dtype="<u4")
_BYTE_CHARS[_OTHERS] = 256 + np.arange(len(_OTHERS))
_BYTE_CHARS[10] = 10  # stands between pieces
_SPACE = r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_AMBIGUOUS = rf"(?:^|[{_SPACE}]) (?:[{_SPACE}]|$)"
#: Classes of bytes; letters beyond ASCII are added by _kinds. What has no class is never cut.
_LETTER, _DIGIT, _MARK, _BREAK = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
for _chars, _k in (("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", _LETTER), ("0123456789", _DIGIT), (",.;:!?|#$%&*", _MARK), ("\n", _BREAK)):
    _KIND[[ord(c) for c in _chars]] = _k


def _kinds(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of each byte of words that start at starts."""
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))  # U+00C0 to U+027F: all letters but two
    lead = lead[~((data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)))]
    kind[lead] = kind[lead + 1] = _LETTER
    first = np.zeros(len(data) + 1, bool)
    first[starts] = first[-1] = True
    space = np.flatnonzero(data == 32)  # a word's space belongs to what follows it
    kind[space] = np.where(first[space + 1], 0, kind[np.minimum(space + 1, len(data) - 1)])
    # a line break is a piece of its own only between two other classes within a word
    at = np.flatnonzero(kind == _BREAK)
    before, after = kind[at - 1], kind[np.minimum(at + 1, len(data) - 1)]
    alone = ~first[at] & ~first[at + 1] & (before % _BREAK > 0) & (after % _BREAK > 0)
    kind[at[~alone]] = 0
    return kind


def _offsets(a: pa.Array) -> np.ndarray:
    """The offsets of a string or binary array, slices included."""
    width = np.int64 if pa.types.is_large_binary(a.type) or pa.types.is_large_string(a.type) else np.int32
    return np.frombuffer(a.buffers()[1], width)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, width)


def _bytes(offsets: np.ndarray, data) -> pa.Array:
    """A large_binary array over a buffer."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), data])


class Encoder:
    """texts -> ids as little-endian unsigned 32-bit integers, equal to encode(add_special_tokens=False)."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.memo_entries = memo_entries
        self._forget()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.size[i] = len(token)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _forget(self) -> None:
        self.known, self.known_ids = pa.array([_HEAD], pa.string()), pa.array([END], pa.large_binary())

    def _whole(self, texts: list[str]) -> pa.Array:
        return pa.array([np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], pa.large_binary())

    def _pure(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces of one class: each is one pre-token, so the model alone gives its ids."""
        ids, ends, done = [], [np.zeros(1, np.int64)], 0
        groups = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(pieces), JOIN_PIECES), len(pieces)), pa.int32()), pieces)
        joined = pc.binary_join(groups, "\n")
        cuts, data = _offsets(joined), np.frombuffer(joined.buffers()[2] or b"", np.uint8)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            raw = data[a:b]
            spelt = _BYTE_CHARS[raw].tobytes().decode("utf-32-le")
            breaks = np.flatnonzero(raw == 10)
            upto = np.append(breaks - np.arange(len(breaks)), len(raw) - len(breaks))
            found = np.asarray(self.model.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, "<u4")
            token_ends = np.cumsum(self.size[found])
            cut = np.searchsorted(token_ends, upto)
            if not (token_ends[-1] == upto[-1] and (token_ends[cut] == upto).all()):
                raise ValueError("the tokenizer isn't a byte-level BPE")
            ids.append(found)
            ends.append((cut + 1 + done) * 4)
            done += len(found)
        return _bytes(np.concatenate(ends), pa.py_buffer(np.concatenate(ids) if ids else b""))

    def _pieces(self, pieces: pa.Array, pure: np.ndarray) -> pa.Array:
        """Ids of distinct pieces; pure tells those of one class."""
        at = pc.index_in(pieces, value_set=self.known)
        new = pc.is_null(at).to_numpy(zero_copy_only=False)
        one, odd = pieces.filter(pa.array(new & pure)), pieces.filter(pa.array(new & ~pure))
        ids = [self.known_ids, self._pure(one), self._whole(odd.to_pylist())]
        where = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        where[new & pure] = len(ids[0]) + np.arange(len(one))
        where[new & ~pure] = len(ids[0]) + len(one) + np.arange(len(odd))
        every = pa.concat_arrays(ids)
        if len(self.known) + len(one) + len(odd) <= self.memo_entries:
            self.known, self.known_ids = pa.concat_arrays([self.known, one, odd]), every
        elif len(self.known) > self.memo_entries // 2:
            self._forget()
        return every.take(pa.array(where))

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words, each after a space unless it has a head."""
        spelt = pc.if_else(pc.starts_with(words, _HEAD), pc.replace_substring(words, _HEAD, "", max_replacements=1), pc.binary_join_element_wise("", words, " "))
        bounds = _offsets(spelt)
        data = np.frombuffer(spelt.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        if not len(data):
            return pa.array([b""] * len(words), pa.large_binary())
        starts = bounds[:-1][np.diff(bounds) > 0]
        kind = _kinds(data, starts)
        first = np.append(False, (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0))
        first[starts] = True
        begins = np.flatnonzero(first)
        cut = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(np.append(begins, len(data)).astype(np.int32)), pa.py_buffer(data)])
        pure = (np.minimum.reduceat(kind, begins) > 0) & (kind[begins] != _BREAK)
        coded = cut.dictionary_encode()
        which = coded.indices.to_numpy()
        pure_of = np.zeros(len(coded.dictionary), bool)
        pure_of[which] = pure
        flat = self._pieces(coded.dictionary, pure_of).take(coded.indices)
        return _bytes(_offsets(flat)[np.searchsorted(begins, bounds)], flat.buffers()[2])

    def encode(self, texts: pa.Array, end: bool = False) -> pa.Array:
        """The ids of each text of a string array without nulls, as large_binary; with end, each is followed by END_ID."""
        if not len(texts):
            return pa.array([], pa.large_binary())
        unsafe = pc.or_(pc.match_substring_regex(texts, _AMBIGUOUS), pc.match_substring(texts, _HEAD))
        for token in self.added:
            unsafe = pc.or_(unsafe, pc.match_substring(texts, token))
        if not (n := pc.sum(unsafe).as_py()):
            return self._gathered(texts, end)
        whole = self._whole(texts.filter(unsafe).to_pylist())
        if end:
            whole = pc.binary_join_element_wise(whole, pa.scalar(END, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        if n == len(texts):
            return whole
        order = np.argsort(np.argsort(unsafe.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        return pa.concat_arrays([self._gathered(texts.filter(pc.invert(unsafe)), end), whole]).take(pa.array(order))

    def _gathered(self, texts: pa.Array, end: bool) -> pa.Array:
        cut = pc.split_pattern(pc.binary_join_element_wise(_HEAD, texts, f" {_HEAD}{_HEAD}" if end else "", ""), " ")
        coded = cut.flatten().dictionary_encode()
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        del cut
        flat = self._words(coded.dictionary).take(coded.indices)
        return _bytes(_offsets(flat)[bounds], flat.buffers()[2])


def id_arrays(coded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all ids of an encoded array one after another, where each text's ids begin and the last ones end)."""
    ends = _offsets(coded)
    data = np.frombuffer(coded.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data.view("<u4"), (ends - ends[0]) // 4


_encoders: dict[tuple[str, int], Encoder] = {}
_lock = threading.Lock()


def encoder(path: str, memo_entries: int = MEMO_ENTRIES) -> Encoder:
    """One encoder per worker and tokenizer file."""
    with _lock:
        if (key := (path, memo_entries)) not in _encoders:
            _encoders[key] = Encoder(path, memo_entries)
        return _encoders[key]


def default_tokenizer() -> str:
    """The tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
