"""Packing of tokenised documents into sequences, as vector bin packing.

Every piece has three demands: tokens, one segment, and loss-bearing tokens. A sequence
has a limit for each. Pieces are placed by the dot-product heuristic: among the pieces that
fit, the open sequence takes the one whose demands, scaled by the limits and by how scarce
each dimension is, have the largest inner product with what the sequence has left.

A document's full sequences are cut off first; what remains of it is packed. When no
remainder fits an open sequence any more, one is cut to fill it. So only the last sequence
of a task's rows is padded.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weftspark.llm.common import batches, release

#: Bytes of text tokenised at once, and remainders packed together.
BATCH_BYTES, BLOCK = 4 << 20, 4096
#: Fixed value: the pattern by which byte-level BPE splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text with all that the pattern tells apart.
PROBE = "The tests'll don't  re-run \n\n 12³ été, ÜBER\t中文! \u00a0x\x1c \U0001f600 a_b  "


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


class ByteIds:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library.

    tiktoken gives the same ids a few times faster where a file's ids are the order of its
    merges; the file's vocabulary is then read as ranks, and a probe text must agree. Texts
    that hold a special string or a run of white space too long for it, and files of another
    kind, are left to the library itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.fast = self._as_ranks(path)
        release()  # reading the file takes several times what stays of it
        if self.fast and not np.array_equal(self.fast.encode_to_numpy(PROBE), self.model.encode(PROBE, add_special_tokens=False).ids):
            self.fast = None

    def _as_ranks(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split = file.get("pre_tokenizer") or {}
        if file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        try:
            ranks = {bytes(byte_of[c] for c in token): k for token, k in file["model"]["vocab"].items() if token not in self.special}
            return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        except (KeyError, ValueError):
            return None

    def ids(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids, end to end."""
        if not text:
            return b""
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
            except ValueError:  # runs of white space of some 700,000 characters are too long for its pattern
                pass
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@dataclass
class Piece:
    """A run of a document's ids; ``row`` is whatever the caller knows the document by.

    ``mask`` has a byte for each id, 1 where it bears loss; None is plain text.
    """

    row: object
    start: int
    ids: bytes
    total: int
    mask: bytes | None = None

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        a, b = (None, None) if self.mask is None else (self.mask[:n], self.mask[n:])
        return Piece(self.row, self.start, self.ids[: 4 * n], self.total, a), Piece(self.row, self.start + n, self.ids[4 * n :], self.total, b)


def all_but_first(piece: Piece) -> int:
    """Loss-bearing tokens of plain text: each but a piece's first, which nothing precedes."""
    return piece.length - 1


def masked(piece: Piece) -> int:
    """Loss-bearing tokens by the piece's mask; its first bears none, as nothing precedes it."""
    return all_but_first(piece) if piece.mask is None else piece.mask.count(1, 1)


def most(piece: Piece, tokens: int, room: int, loss) -> int:
    """The longest head of so many tokens at most whose loss fits the room."""
    if tokens <= room or loss(piece.cut(tokens)[0]) <= room:
        return tokens
    low, high = 0, tokens
    while high - low > 1:
        n = (low + high) // 2
        low, high = (n, high) if loss(piece.cut(n)[0]) <= room else (low, n)
    return low


def pack(pieces: list[Piece], limits: Limits, loss=all_but_first, cuttable: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    """Closed sequences, and the pieces of the one that is still open at the end.

    ``loss`` gives a piece's loss-bearing tokens; it may not exceed its length nor fall when the
    piece grows. A piece that
    exceeds a limit alone is cut, or gets a ValueError where pieces may not be cut.
    """
    pieces = list(pieces)
    need = np.array([(p.length, 1, loss(p)) for p in pieces], float).reshape(-1, 3)
    limit = np.array([limits.tokens, limits.segments, limits.loss], float)
    if not cuttable and (need > limit).any():
        raise ValueError("a piece exceeds a limit of its own")
    scarce = need.sum(0) / limit  # sequences' worth of each dimension
    weight = need / limit * scarce / max(scarce.sum(), 1e-9)
    alive = np.ones(len(pieces), bool)
    closed: list[list[Piece]] = []
    now: list[Piece] = []
    left = limit.copy()
    while alive.any():
        fits = alive & (need <= left).all(1)
        if fits.any():
            k = int(np.argmax(np.where(fits, weight @ (left / limit), -1.0)))
            alive[k] = False
            now.append(pieces[k])
            left -= need[k]
        else:
            if cuttable and left[:2].min() >= 1:
                k = int(np.argmax(np.where(alive, weight @ (left / limit), -1.0)))
                n = most(pieces[k], int(min(left[0], pieces[k].length - 1)), int(left[2]), loss)
                if n > 0:
                    head, pieces[k] = pieces[k].cut(n)
                    now.append(head)
                    need[k] = pieces[k].length, 1, loss(pieces[k])
                    weight[k] = need[k] / limit * scarce / max(scarce.sum(), 1e-9)
            closed.append(now)
            now, left = [], limit.copy()
        if now and left[0] == 0:
            closed.append(now)
            now, left = [], limit.copy()
    return closed, now


def pack_documents(docs: DataFrame, path: str, *, limits: Limits = Limits(), end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", mask: Callable[[str | None, np.ndarray], np.ndarray] | None = None) -> DataFrame:  # noqa: B008
    """Pieces of all documents: id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; a very long one is encoded whole. Repeated rows
    are packed each. A
    task packs its own rows, so no rows are exchanged; only its last sequence is padded.
    Other columns play no part; an empty table gives no rows. ``mask`` is given a text and its
    ids, the end id last, and tells for each whether it bears loss; the rows then have their
    part of it too (binary, a byte an id). Without it all of a piece's tokens but the first do.
    """
    full = min(limits.tokens, limits.loss + 1)
    extra = [] if mask is None else [("mask", pa.binary())]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base, count = ByteIds(path), TaskContext.get().partitionId() << 40, 0
        waiting: list[Piece] = []

        def rows(sequences: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal count
            out = []
            for s in sequences:
                at = 0
                for p in s:
                    out.append((p.row, p.start, p.length, p.ids, p.total, base + count, at, *([p.mask] if extra else [])))
                    at += p.length
                count += 1
            for i in range(0, len(out), 2048):
                columns = list(zip(*out[i : i + 2048], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), *(t for _, t in extra)), strict=True)], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", *(n for n, _ in extra)])

        end, kind = np.array([end_id], "<u4").tobytes(), None
        for batch in batches(source, "text", BATCH_BYTES):
            kind = batch.column(0).type
            whole: list[list[Piece]] = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text) + end
                total = len(ids) // 4
                if mask is None:
                    for at in range(0, total - full + 1, full):
                        whole.append([Piece(row, at, ids[4 * at : 4 * (at + full)], total)])
                    if total % full:
                        waiting.append(Piece(row, total - total % full, ids[4 * (total - total % full) :], total))
                else:
                    bears = np.asarray(mask(text, np.frombuffer(ids, "<u4")), bool)
                    if len(bears) != total:
                        raise ValueError("a mask needs a value for each id")
                    before, at = np.concatenate([[0], np.cumsum(bears)]), 0
                    while at < total:
                        # As much as fits a sequence; where loss is what ends it, others may still fill it.
                        n = min(limits.tokens, int(np.searchsorted(before, limits.loss + before[at + 1], "right")) - 1 - at)
                        piece = Piece(row, at, ids[4 * at : 4 * (at + n)], total, bears[at : at + n].tobytes())
                        if n == limits.tokens:
                            whole.append([piece])
                        else:
                            waiting.append(piece)
                        at += n
                if len(waiting) >= BLOCK:
                    closed, waiting = pack(waiting, limits, masked)
                    whole += closed
                if len(whole) >= 1024:
                    yield from rows(whole)
                    whole = []
            yield from rows(whole)
            release()
        closed, now = pack(waiting, limits, masked)
        yield from rows(closed + [now] * bool(now))

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    packed = rows.mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long" + ", mask binary" * bool(extra))
    return packed.withColumnRenamed("id", id_column)
