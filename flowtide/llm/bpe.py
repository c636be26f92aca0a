"""BPE encoding and decoding: a backtracking encoder over longest matches, an offset table for decoding.

The encoder walks a piece of text left to right. An Aho-Corasick automaton over the vocabulary gives the longest token that
starts at each place; a token may follow another only if no merge that ranks before theirs crosses their border, which the pair
table answers. Where no token fits, the last one is shortened to its longest prefix token, and places found dead are never
entered again, so the work is linear in the text. Results equal those of applying all merges in order of rank.

Pieces come from the pre-tokenizer's pattern. Encoded pieces and looked-up token pairs are kept in caches of bounded size.
Decoding gathers bytes through an offset table with numpy.

Defined cases: null text is empty: no ids, and an empty decoded text; repeated rows and null ids give a row each; a text of any length
is one row in memory with its ids; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, ids_and_text, table, utf8

#: The pattern of the byte-level pre-tokenizer (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Distinct pieces in each of the cache's two generations, and the longest piece (code points) that is kept.
CACHE_PIECES, CACHE_CHARS = 200_000, 48
#: Token pairs whose compatibility is kept at most.
CACHE_PAIRS = 1 << 18
NONE = -1


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in printable}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}


class ByteBPE:
    """A byte-level BPE vocabulary. Inside, token numbers are merge ranks: bytes 0-255, then the merges in order."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        as_bytes = lambda token: bytes(back[c] for c in token)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        self.tokens: list[bytes] = [bytes([b]) for b in range(256)] + [as_bytes(a + b) for a, b in merges]
        rank = {t: i for i, t in enumerate(self.tokens)}
        self.left, self.right, self.pairs = list(range(256)), list(range(256)), {}
        for i, (a, b) in enumerate(merges, 256):
            x, y = rank[as_bytes(a)], rank[as_bytes(b)]
            self.left.append(x)
            self.right.append(y)
            self.pairs[x, y] = i
        public = {as_bytes(t): i for t, i in vocab.items()}
        self.public = [public[t] for t in self.tokens]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self._added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._pattern = regex.compile(PATTERN)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.automaton.add_word(t.decode("latin-1"), (len(t) - 1, i))
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.tokens]
        # the longest proper prefix of each token that is a token itself
        self.shorter = [next((rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in rank), NONE) for t in self.tokens]
        table_size = 1 + max([*self.public, *self.added.values()])
        by_id: list[bytes] = [b""] * table_size
        for i, t in zip(self.public, self.tokens, strict=True):
            by_id[i] = t
        for content, i in self.added.items():
            by_id[i] = content.encode()
        self.sizes = np.array([len(t) for t in by_id], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.store = np.frombuffer(b"".join(by_id), np.uint8)
        self.decimals = [str(i) for i in range(table_size)]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most_known = CACHE_PIECES
        self.fitting: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a, b can stand side by side: no merge across their border comes before the merges that made them."""
        limit = len(self.tokens)
        while True:
            made = self.pairs.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:
                limit, a = a, self.right[a]
                if a == limit:
                    limit, b = b + 1, self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    if a == limit:
                        return True

    def longest(self, piece: bytes) -> list[int]:
        """The longest token that starts at each place."""
        out = [NONE] * len(piece)
        for end, (back, token) in self.automaton.iter(piece.decode("latin-1")):
            out[end - back] = token  # for one start, later ends are longer
        return out

    def fits(self, a: int, b: int) -> bool:
        """:meth:`compatible`, remembered."""
        if len(self.fitting) >= CACHE_PAIRS:
            self.fitting.clear()
        made = self.fitting[a * len(self.tokens) + b] = self.compatible(a, b)
        return made

    def encode_piece(self, piece: bytes) -> list[int]:
        """Merge ranks of the tokens of one piece."""
        if not piece:
            return []
        best, n = self.longest(piece), len(piece)
        length, shorter, fitting, size = self.length, self.shorter, self.fitting, len(self.tokens)
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, best[0]
        while True:
            while token != NONE:
                end = at + length[token]
                if alive[end]:
                    fit = fitting.get(out[-1] * size + token) if out else True
                    if fit or (fit is None and self.fits(out[-1], token)):
                        out.append(token)
                        at = end
                        break
                token = shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]
                token = shorter[token]
                continue
            if at == n:
                return out
            token = best[at]

    def piece(self, piece: str) -> bytes:
        """Ids of a piece as packed 32-bit numbers."""
        made = self.older.get(piece)
        if made is None:
            public = self.public
            made = array("I", [public[t] for t in self.encode_piece(piece.encode())]).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self.known) >= self.most_known:  # what was used lately moves on to the next generation
                self.older, self.known = self.known, {}
            self.known[piece] = made
        return made

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as packed 32-bit numbers. Contents of added tokens get their own ids."""
        packed: list[bytes] = []
        piece = self.piece
        for k, part in enumerate(self._added.split(text) if self._added else [text]):
            if k % 2:
                packed.append(array("I", [self.added[part]]).tobytes())
                continue
            known = self.known.get  # a full generation that is put away meanwhile still answers
            packed.extend([known(p) or piece(p) for p in self._pattern.findall(part)])
        return b"".join(packed)

    def decimal(self, ids: np.ndarray) -> str:
        """The ids as decimal text, joined by commas."""
        return ",".join(map(self.decimals.__getitem__, ids.tolist()))

    def encode(self, text: str) -> list[int]:
        """Public ids of a text."""
        return np.frombuffer(self.encode_packed(text), np.uint32).tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered through the offset table."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        shift = np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.store[np.arange(ends[-1]) + shift].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that aren't UTF-8 become the replacement character."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


@cache
def load(path: str) -> ByteBPE:
    """One vocabulary per Python worker."""
    return ByteBPE(path)


def default_path() -> str:
    """Where the public byte-level vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>), decimal (ids joined by commas) of each whole text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for cut in range(0, batch.num_rows, 500):  # bounds what is held at once
                part = batch.slice(cut, 500)
                made = [np.frombuffer(bpe.encode_packed(t or ""), np.uint32) for t in part["text"].to_pylist()]
                values = np.concatenate([np.zeros(0, np.uint32), *made]).astype(np.int32)
                ends = np.cumsum([0, *map(len, made)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids, pa.array(map(bpe.decimal, made), pa.string())], ["doc_id", "ids", "decimal"])

    return arrow_map(ids_and_text(docs), run, "doc_id long, ids array<int>, decimal string")


_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, round_trip boolean"


def encode_and_decode(docs: DataFrame, path: str | None = None, cache_pieces: int = CACHE_PIECES, release: bool = False) -> DataFrame:
    """Encode each whole text, decode the ids, and digest both. cache_pieces trades a worker's memory for time; release drops vocabulary
    and caches after each task, for jobs whose other stages need the workers' memory."""
    path = path or default_path()

    def digest(bpe: ByteBPE, part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, raw in zip(part["text"].to_pylist(), utf8(part["text"]), strict=True):
            ids = np.frombuffer(bpe.encode_packed(text or ""), np.uint32)
            back = bpe.decode_bytes(ids).decode("utf-8", "replace").encode()
            rows.append((len(ids), hashlib.sha256(bpe.decimal(ids).encode()).hexdigest(), hashlib.sha256(back).hexdigest(), len(raw), back == raw))
        c = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(v, t) for v, t in zip(c, kinds, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "round_trip"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        bpe.most_known = cache_pieces
        try:
            for batch in batches:
                for cut in range(0, batch.num_rows, 500):
                    yield digest(bpe, batch.slice(cut, 500))
        finally:
            if release:
                load.cache_clear()

    return arrow_map(ids_and_text(docs), run, _DIGEST)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op10_bpe."""
    return encode_and_decode(table(spark, sf_dir, "documents"))
