"""BPE encoding and decoding with a public vocabulary file.

Encoding a word: its symbols form a doubly linked list; every neighbouring pair
that has a merge rank enters a priority queue by (rank, place).  The least entry
merges its two symbols unless it is stale (one of them has been merged away
since), and the merged symbol's two new pairs are queued.  That costs
n log n for a word of n symbols, however long.  Words recur, so each worker
keeps a bounded table of words already encoded.  Decoding looks up each id's
vocabulary string and joins them, as the file's missing decoder prescribes, by
single spaces.

The file (its path is a parameter) gives the vocabulary, the merges, the
end-of-word suffix, the added tokens and the split pattern; supported are its
normalisers NFC, white-space folding and lower-casing, and byte-level symbols.

Cases: null text is empty; an empty text gives no ids and decodes to the empty
text; added tokens written out in a text are those tokens; an empty table gives
an empty result; extra columns are ignored.  Nothing is shuffled."""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm import common as C

KNOWN_WORDS = 100_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself for visible
    Latin-1 characters, else the next free one from 256 up."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.rank, self.merged = {}, {}
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = self.vocab[a], self.vocab[b]
            self.rank[pair] = k
            self.merged[pair] = self.vocab[a + b]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.string = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split.replace(r"[^\s", r"[^\p{White_Space}"), regex.V0)
        self.symbol = byte_symbols()
        self.known: dict[str, tuple[bytes, bytes, int]] = {}

    def word_ids(self, word: str) -> list[int]:
        sym = [self.symbol[b] for b in word.encode()]
        sym[-1] += self.suffix
        ids = [self.vocab[s] for s in sym]
        n = len(ids)
        if n == 1:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, merged = self.rank, self.merged
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale: a side has been merged since
            ids[i], ids[j] = merged[a, b], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(queue, (r, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(queue, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def normal(self, text: str) -> str:
        return (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()

    def _entry(self, ids: list[int]) -> tuple[bytes, bytes, int]:
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(self.string[i] for i in ids).encode(), len(ids)

    def pieces(self, text: str) -> list[tuple[bytes, bytes, int]]:
        """(ids as little-endian bytes, their strings joined, how many) word by word."""
        known, out = self.known, []
        parts = self.split_added.split(text) if self.split_added and "<|" in text else (text,)
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self._entry([self.added[part]]))
                continue
            for w in self.pattern.findall(self.normal(part)):
                got = known.get(w)
                if got is None:
                    got = self._entry(self.word_ids(w))
                    if len(w) < 64:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        known[w] = got
                out.append(got)
        return out

    def encode(self, text: str) -> list[int]:
        raw = b"".join([p[0] for p in self.pieces(text)])
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.string[i] for i in ids if i in self.string])


@lru_cache(4)
def load(path: str) -> Bpe:
    """Once per worker process."""
    return Bpe(path)


_OUT = "doc_id long, n_tokens long, ids binary, decoded binary"
_OUT_PA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
_SHA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_SHA_PA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _run(path: str, digest: bool):
    schema = _SHA_PA if digest else _OUT_PA

    def rows(batches):
        bpe = load(path)
        for batch in batches:
            for part, _, _ in C.pieces(batch, "text", 4 * C.PIECE):
                count, ids, decoded = [], [], []
                for text in part.column("text").to_pylist():
                    got = bpe.pieces(text)
                    a, b = b"".join([p[0] for p in got]), b" ".join([p[1] for p in got])
                    count.append(len(a) // 4)
                    ids.append(hashlib.sha256(a).hexdigest() if digest else a)
                    decoded.append(hashlib.sha256(b).hexdigest() if digest else b)
                yield C.record(schema, part.column("doc_id"), count, ids, decoded)
    return rows


def encode_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (UTF-8)."""
    return _texts(docs, text, doc_id).mapInArrow(_run(path, False), _OUT)


def digest_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The same, with SHA-256 digests in place of the ids and the decoded text."""
    return _texts(docs, text, doc_id).mapInArrow(_run(path, True), _SHA)


def _texts(docs, text, doc_id):
    return C.bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op3(spark, sf_dir: str) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
