"""Token ids of whole texts, encoded by public tokenizer files inside Python workers.

A worker keeps one encoder per vocabulary file. For tokenizers that drop
white space (word BPE), a text's ids are the ids of its white-space-separated
chunks one after another, so the encoder caches the ids of each chunk and only
asks the library for chunks it has not met: invented and natural prose alike
repeat most of theirs. Other tokenizers are asked for whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the split pattern of the word BPE file, whose pieces never hold white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Chunks that are one run of Latin letters and one run of marks other than the apostrophe: two pre-tokens.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)([.,!?;:*%$#&|]*)")

#: Bytes of chunks and ids that a worker remembers before it starts anew, what one costs besides its characters and ids,
#: and the characters from which a chunk is not remembered (scripts without spaces make a chunk of every sentence).
CACHE_BYTES, ENTRY_BYTES, LONGEST_CHUNK = 160 << 20, 200, 64

#: Bytes of text whose chunks are told apart together; a longer text goes alone.
SLICE_BYTES = 4 << 20

_ENCODERS: dict[tuple, object] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordEncoder:
    """``ids(text)``: little-endian uint32 ids as bytes; ``count(text)``: how many; ``each(texts)``: the ids one by one."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model
        letters = _byte_letters()
        self._spell = {
            ord(c): "".join(letters[b] for b in c.encode())
            for c in map(chr, [*range(0xC0, 0x100)])
        }
        self._room = cache_bytes
        self._ids: dict[str, bytes] = {"": b""}
        self.held = 0  # bytes, about

    @staticmethod
    def fits(spec: dict) -> bool:
        """Whether white space only separates in this tokenizer, so chunks can be encoded one by one."""
        steps = spec.get("pre_tokenizer") or {}
        parts = steps.get("pretokenizers", [])
        normal = spec.get("normalizer") or {}
        kinds = [n.get("type") for n in normal.get("normalizers", [])]
        return (
            len(parts) == 2
            and parts[0].get("type") == "Split"
            and parts[0].get("pattern") == {"Regex": WORD_PATTERN}
            and parts[0].get("behavior") == "Removed"
            and parts[0].get("invert") is True
            and parts[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            and kinds == ["NFC", "Replace", "Lowercase"]
            and spec.get("post_processor") is None
            and all(
                not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"])
                and not re.search(r"\s", a["content"])
                for a in spec.get("added_tokens", [])
            )
        )

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Pieces between plain white space; rarer white space stays inside a piece for the library."""
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each chunk: its own merges for plain Latin words, the library's whole path for the rest."""
        plain = {w: (m[1].lower(), m[2]) for w in words if (m := _PLAIN.fullmatch(w))}
        rest = [w for w in words if w not in plain]
        rest += {mark for _, mark in plain.values() if mark}
        out = {}
        if rest:
            for w, e in zip(rest, self._tokenizer.encode_batch(rest, add_special_tokens=False)):
                out[w] = np.array(e.ids, "<u4").tobytes()
        known = self._merged({body for body, _ in plain.values() if body not in self._ids})
        for w, (body, mark) in plain.items():
            got = known[body] if body in known else self._ids[body]
            out[w] = got + out[mark] if mark else got
        return out

    def _merged(self, bodies: set[str]) -> dict[str, bytes]:
        """The ids of each lower-case run of Latin letters, by its merges."""
        tokenize = self._model.tokenize
        ids, ends = [], []
        for body in bodies:
            spelt = body if body.isascii() else body.translate(self._spell)
            ids += [t.id for t in tokenize(spelt)]
            ends.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        return {b: data[lo:hi] for b, lo, hi in zip(bodies, [0, *ends], ends)}

    def ids(self, text: str) -> bytes:
        words = self.chunks(text)
        parts = list(map(self._ids.get, words))
        if None in parts:
            new = self.encode_words({w for w, p in zip(words, parts) if p is None})
            parts = [new[w] if p is None else p for w, p in zip(words, parts)]
            self._keep(new)
        return b"".join(parts)

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text in turn (null: none), as uint32.

        Arrow cuts ``SLICE_BYTES`` of texts into chunks and tells these apart, so
        a chunk is looked up once a slice, and its ids are set in for its repeats.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        lo = 0
        while lo < len(texts):
            most = SLICE_BYTES + (ends[lo - 1] if lo else 0)
            hi = max(lo + 1, int(np.searchsorted(ends, most, "right")))
            chunks = pc.ascii_split_whitespace(texts.slice(lo, hi - lo))
            told = chunks.flatten().dictionary_encode()
            parts = self._known(told.dictionary.to_numpy(zero_copy_only=False).tolist())
            bounds = np.zeros(len(parts) + 1, "i8")
            np.cumsum(np.fromiter(map(len, parts), "i8", len(parts)) // 4, out=bounds[1:])
            every = pa.LargeListArray.from_arrays(bounds, np.frombuffer(b"".join(parts), "<u4")).take(told.indices)
            places = every.offsets.to_numpy()[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]
            ids = every.values.to_numpy()
            for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
                yield ids[a:b]
            lo = hi

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of each of some different chunks."""
        parts = list(map(self._ids.get, words))
        if None in parts:
            new = self.encode_words({w for w, p in zip(words, parts) if p is None})
            parts = [new[w] if p is None else p for w, p in zip(words, parts)]
            held = self.held
            self._keep(new)
            if self.held < held:  # begun anew: the chunks at hand are mostly the frequent ones
                self._keep({w: p for w, p in zip(words, parts) if w not in self._ids})
        return parts

    def _keep(self, new: dict[str, bytes]) -> None:
        """Remember the ids of chunks that aren't long; begin anew where there is no more room."""
        for w, ids in new.items():
            if len(w) < LONGEST_CHUNK:
                if self.held > self._room:
                    self._ids, self.held = {"": b""}, 0
                self._ids[w] = ids
                self.held += entry_bytes(w, len(ids))

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


class _OneByOne:
    """Encoders that are asked for one whole text at a time."""

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        return (np.frombuffer(self.ids(t or ""), "<u4") for t in texts.to_pylist())


class LibraryEncoder(_OneByOne):
    """Whole texts through the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()

    def ids(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def count(self, text: str) -> int:
        return len(self._tokenizer.encode(text, add_special_tokens=False).ids)


class PieceEncoder(_OneByOne):
    """Whole texts through ``sentencepiece``, without begin or end ids."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> bytes:
        return np.array(self._model.encode(text), "<u4").tobytes()

    def count(self, text: str) -> int:
        return len(self._model.encode(text))


def entry_bytes(word: str, payload: int) -> int:
    """What a remembered chunk costs, about: a character may take 4 bytes."""
    return ENTRY_BYTES + (1 if word.isascii() else 4) * len(word) + payload


def largest_id(path: str) -> int:
    """The largest id that a vocabulary file (``.json`` or ``.model``) gives, added tokens included."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size() - 1
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)


def encoder(path: str):
    """This worker's encoder for a vocabulary file (``.json`` or ``.model``), made once."""
    if path not in _ENCODERS:
        if path.endswith(".model"):
            _ENCODERS[path] = PieceEncoder(path)
        else:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            _ENCODERS[path] = WordEncoder(path) if WordEncoder.fits(spec) else LibraryEncoder(path)
    return _ENCODERS[path]


def splits_on_white_space(path: str) -> bool:
    """Whether the chunk caches apply to this vocabulary file."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        return WordEncoder.fits(json.load(f))
