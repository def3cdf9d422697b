"""Packing token sequences: hierarchical multi-length windows.

A document's full windows of the longest tier go out as they are. What remains of it is routed to the shortest tier that
holds it. Tiers are packed from the longest: each remainder opens a window of its tier, and the window's gap is filled
with the largest remainders of shorter tiers that fit, then with the head of one more. So windows are full, at a power
of two each; only a task's last tokens have to be cut up by powers of two. Sequences of all tiers are dealt to step
groups of equal tokens.

Everything happens in the task that tokenizes a partition: no shuffle, and no more in memory than BUFFER tokens.
"""

from __future__ import annotations

import heapq
import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_of

#: Sequence lengths of the tiers, the longest first; tokens that a task packs at once; tokens of a step group.
TIERS = (1024, 512, 256, 128)
BUFFER = 1 << 21
STEP_TOKENS = 16 * TIERS[0]

_ROW = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"


def token_bytes(path: str) -> Callable[[str], bytes]:
    """Function that gives a text's ids of a byte-level BPE tokenizer file as little-endian unsigned 32-bit numbers."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    specials = [t["content"] for t in spec.get("added_tokens", [])]
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printed)}
    ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in specials}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        ids = whole.encode(text, add_special_tokens=False).ids if any(s in text for s in specials) else fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    return encode


class _Packer:
    """Packs pieces (document number, start, length) of a buffer; what fills no window stays for the next one."""

    def __init__(self) -> None:
        self.pool: dict[int, list[tuple[int, int, int]]] = {t: [] for t in TIERS}

    def add(self, doc: int, start: int, length: int) -> None:
        """Route a remainder of at most TIERS[0] tokens to its tier, kept in the order of length."""
        insort(self.pool[min(t for t in TIERS if t >= length)], (length, doc, start))

    def _fill(self, tier: int, gap: int) -> Iterator[tuple[int, int, int]]:
        shorter = [t for t in TIERS if t < tier]
        while gap:
            for t in shorter:
                own = self.pool[t]
                if own and own[0][0] <= gap:
                    piece = own.pop(bisect_right(own, (gap, 1 << 62, 0)) - 1)
                    break
            else:
                found = next((t for t in (*shorter, tier) if self.pool[t]), None)
                if found is None:
                    return
                length, doc, start = self.pool[found].pop()
                take = min(length, gap)
                piece = (take, doc, start)
                if length > take:
                    self.add(doc, start + take, length - take)
            gap -= piece[0]
            yield piece

    def windows(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        """Windows as lists of (length, document, start). Unless last, one that can't be filled goes back."""
        for tier in TIERS:
            while self.pool[tier]:
                first = self.pool[tier].pop()
                window = [first, *self._fill(tier, tier - first[0])]
                size = sum(p[0] for p in window)
                if size == tier:
                    yield window
                elif last:
                    yield from _by_powers(window, size)
                else:
                    for length, doc, start in window:
                        self.add(doc, start, length)
                    return


def _by_powers(window: list[tuple[int, int, int]], size: int) -> Iterator[list[tuple[int, int, int]]]:
    """Cut a window into windows of powers of two."""
    todo = window[::-1]
    while size:
        room = 1 << (size.bit_length() - 1)
        size -= room
        out = []
        while room:
            length, doc, start = todo.pop()
            take = min(length, room)
            out.append((take, doc, start))
            if length > take:
                todo.append((length - take, doc, start + take))
            room -= take
        yield out


def _packed(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_bytes(path)
        base = TaskContext.get().partitionId() << 40
        packer, docs, sequences, steps = _Packer(), [], 0, 0
        held, full = 0, []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, steps, held, docs
            made = [*full, *packer.windows(last)]
            full.clear()
            sizes = [sum(p[0] for p in w) for w in made]
            n_steps = -(-sum(sizes) // STEP_TOKENS)
            loads = [(0, steps + i) for i in range(n_steps)]
            steps += n_steps
            out: dict[str, list] = {n: [] for n in names}
            for i in sorted(range(len(made)), key=lambda i: -sizes[i]):
                load, step = heapq.heappop(loads)
                heapq.heappush(loads, (load + sizes[i], step))
                offset = 0
                for length, d, start in made[i]:
                    key, ids = docs[d]
                    row = (key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, base + sequences, offset, sizes[i], base + step)
                    for n, v in zip(names, row, strict=True):
                        out[n].append(v)
                    offset += length
                sequences += 1
            rest, number = [], {}
            for own in packer.pool.values():  # the documents that stay get new numbers
                for _, d, _ in own:
                    if d not in number:
                        number[d] = len(rest)
                        rest.append(docs[d])
                own[:] = sorted((length, number[d], start) for length, d, start in own)
            docs, held = rest, 0
            kinds = [key_type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)], names=names)

        key_type = pa.int64()
        for b in batches:
            key_type = b.column(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text) + b"\0\0\0\0"
                n, d = len(ids) // 4, len(docs)
                docs.append((key, ids))
                held += n
                whole = n // TIERS[0] * TIERS[0]
                full.extend([(TIERS[0], d, s)] for s in range(0, whole, TIERS[0]))
                if n > whole:
                    packer.add(d, whole, n - whole)
                if held >= BUFFER:
                    yield from flush(False)
        yield from flush(True)

    return run


def packed(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens, each full at a power of two.

    tokenizer: path of a byte-level BPE file, the same on all executors. A document is its text's ids, then id 0; a null
    or empty text is id 0 alone. Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, tier (the sequence's length), step_id (step groups hold about STEP_TOKENS tokens). Each row of docs is packed
    on its own, whether or not keys repeat or are null. No rows give none; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = _ROW.format(id=kind)
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")).mapInArrow(_packed(tokenizer, names), schema)
