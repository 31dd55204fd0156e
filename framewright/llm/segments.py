"""Sampled segmentations over a piece vocabulary: forward filtering, backward sampling; lossless decoding.

All pieces of the vocabulary that match a text form a lattice. The forward pass sums the weights of
the paths to each position; sampling walks back from the end, choosing each piece with its share.
The random numbers are hashes of a seed, the row's key and the position, so a row's segmentation does
not depend on how rows are dealt.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.base import held, pieces, text_column, tidy
from framewright.llm.tokens import tokenizer_path
from framewright.llm.words import Probed, _power_tables, mixed

UNIT = re.compile(rb" +[^ ]*|[^ ]+")
MARK = "▁"
#: Bytes of text whose lattice is held at a time; the units they share are built once.
PIECE = 4 << 20


class _Numbers(dict):
    """Numbers keys in the order in which they first come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = len(self)
        return self[key]


class Lattice:
    """Vocabulary of a SentencePiece model with byte pieces, and sampling over it.

    A piece weighs exp(-theta ln(2 + rank)), its rank being its place in the model's merge order; byte pieces
    rank last and are offered only for characters that are no piece themselves. A text gets a space in
    front; as no piece has a space behind another character, the text falls into units there, and each
    different unit's lattice is built once, whole, however long it is.
    """

    def __init__(self, path: str, theta: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_id = np.full(256, -1, "i4")
        self.surface: list[bytes] = [b""] * model.get_piece_size()
        normal = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                own = piece.replace(MARK, " ").encode()
                if re.fullmatch(UNIT, own):
                    normal.append((own, i, -theta * np.log(2 - min(model.get_score(i), 0.0))))
                    self.surface[i] = own
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        self.longest = max(len(own) for own, _, _ in normal)
        self.byte_weight = float(-theta * np.log(2 + 2 * len(self.surface)))
        prefixes = sorted({own[:k] for own, _, _ in normal for k in range(1, len(own) + 1)})
        key = self._hash_of(prefixes)
        whole = {own: i for own, i, _ in normal}
        self.prefix = Probed(key, np.array([whole.get(p, -1) for p in prefixes], "f8"))
        self.weight = np.zeros(len(self.surface))
        self.weight[[x[1] for x in normal]] = [x[2] for x in normal]

    @staticmethod
    def _running(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power, inverse = _power_tables(len(raw) + 1)
        running = np.zeros(len(raw) + 1, "u8")
        np.cumsum((raw.astype("u8") + np.uint64(1)) * power[:-1], out=running[1:])
        return running, inverse

    @classmethod
    def _hash_of(cls, parts: list[bytes]) -> np.ndarray:
        size = np.array([len(p) for p in parts], "i8")
        running, inverse = cls._running(np.frombuffer(b"".join(parts), np.uint8))
        stop = np.cumsum(size)
        return mixed((running[stop] - running[stop - size]) * inverse[stop - size] ^ (size.astype("u8") << np.uint64(56)))

    def edges(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lattice of the concatenated units: end, start, piece and weight of each edge, and the units' bounds."""
        raw = np.frombuffer(b"".join(units), np.uint8)
        size = np.array([len(u) for u in units], "i8")
        bound = np.concatenate([[0], np.cumsum(size)])
        running, inverse = self._running(raw)
        left = np.repeat(bound[1:], size) - np.arange(len(raw))  # bytes to the unit's end
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        starts, ends, ids = [], [], []
        for k in range(1, self.longest + 1):
            at = at[left[at] >= k]
            if not len(at):
                break
            key = mixed((running[at + k] - running[at]) * inverse[at] ^ np.uint64(k << 56))
            piece, alive = self.prefix(key)
            found = alive & (piece >= 0)
            starts.append(at[found])
            ends.append(at[found] + k)
            ids.append(piece[found].astype("i4"))
            at = at[alive]
        start, end, piece = (np.concatenate(x) for x in (starts, ends, ids))
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        width = np.diff(np.append(lead, len(raw)))
        covered = np.zeros(len(raw) + 1, bool)
        char_end = np.zeros(len(raw) + 1, "i8")
        char_end[lead] = lead + width
        covered[start[end == char_end[start]]] = True
        bare = np.repeat(~covered[lead], width)
        plain = np.flatnonzero(bare)
        weight = np.concatenate([self.weight[piece], np.full(len(plain), self.byte_weight)])
        start, end, piece = np.concatenate([start, plain]), np.concatenate([end, plain + 1]), np.concatenate([piece, self.byte_id[raw[plain]]])
        return end, start, piece, weight, bound

    def filtered(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward pass over distinct units: start, piece and cumulative share of each edge, by end; each end's first edge; bounds."""
        end, start, piece, weight, bound = self.edges(units)
        # Where no piece crosses a position every path meets, so shares before and after it are independent.
        crossed = np.cumsum(np.bincount(start + 1, minlength=bound[-1] + 2) - np.bincount(end, minlength=bound[-1] + 2))[: bound[-1]]
        unit_start = np.maximum.accumulate(np.where(crossed > 0, 0, np.arange(bound[-1])))
        offset = end - unit_start[end - 1]
        order = np.argsort((offset * (bound[-1] + 1) + end) * (self.longest + 1) + end - start)  # no two are equal
        end, start, piece, weight, offset = (x[order] for x in (end, start, piece, weight, offset))
        total = np.zeros(bound[-1] + 1)
        share = np.zeros(len(end))
        cuts = np.searchsorted(offset, np.arange(1, offset[-1] + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            own, s = end[a:b], start[a:b]
            before = np.where(s == unit_start[own - 1], 0.0, total[s])
            x = before + weight[a:b]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            most = np.maximum.reduceat(x, first)
            each = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own))))
            p = np.exp(x - most[each])
            whole = np.add.reduceat(p, first)
            total[own[first]] = most + np.log(whole)
            run = np.cumsum(p)
            share[a:b] = (run - (run[first] - p[first])[each]) / whole[each]
        order = np.argsort(end, kind="stable")
        share, end = share[order], end[order]
        share[np.append(np.diff(end) != 0, True)] = 1.0
        return start[order], piece[order], share, np.searchsorted(end, np.arange(bound[-1] + 1)), bound

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text, drawn with the seed of its row; an empty text has none."""
        index = _Numbers()
        unit, size, number = [], [], []
        for text in texts:
            own = UNIT.findall(b" " + text.encode()) if text else []
            unit += map(index.__getitem__, own)
            size += map(len, own)
            number.append(len(own))
        if not unit:
            return [np.zeros(0, "i4") for _ in texts]
        owner = np.repeat(np.arange(len(texts)), number)
        size = np.array(size, "i8")
        place = np.cumsum(size) - size
        text_end = np.cumsum(number)
        place -= np.append(place, 0)[text_end - number][owner]
        start, piece, share, edge_of, bound = self.filtered(list(index))
        unit = np.array(unit)
        first, here = bound[unit], bound[unit + 1].copy()
        live = np.arange(len(unit))
        seen, chosen = [], []
        while len(live):
            position = (place[live] + here[live] - first[live]).astype("u8")
            draw = mixed(seeds[owner[live]] + mixed(position + np.uint64(1)))
            u = (draw >> np.uint64(11)).astype("f8") * 2.0**-53
            edge = edge_of[here[live]]
            rest = np.flatnonzero(share[edge] <= u)
            while len(rest):
                edge[rest] += 1
                rest = rest[share[edge[rest]] <= u[rest]]
            seen.append(live)
            chosen.append(edge)
            here[live] = start[edge]
            live = live[here[live] > first[live]]
        whose, edge = np.concatenate(seen), np.concatenate(chosen)
        order = np.argsort(whose * (np.diff(bound).max() + 1) + (start[edge] - first[whose]))
        ids = piece[edge[order]]
        cut = np.searchsorted(owner[whose[order]], np.arange(len(texts) + 1))
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids; the space in front of the first word goes."""
        return b"".join(map(self.surface.__getitem__, ids.tolist()))[1:].decode()


def lattice_of(path: str, theta: float) -> Lattice:
    return held("lattice", (path, theta), lambda: Lattice(path, theta))


def row_seeds(keys: list[int | None], seed: int) -> np.ndarray:
    return mixed(np.array([(k or 0) & (1 << 64) - 1 for k in keys], "u8") + mixed(np.array([seed], "u8")))


def sampled(docs: DataFrame, path: str, seed: int = 0, theta: float = 1.0) -> DataFrame:
    """(doc_id, ids) of ``docs(doc_id, text)``: one sampled segmentation a row.

    A null text is empty and has no ids. Rows of one doc_id and text have equal ids; a null doc_id
    draws as id 0. Texts are sampled whole; a run without a cut costs time in proportion to its length.
    """

    def run(batches):
        lattice = lattice_of(path, theta)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                keys = part.column("doc_id").to_pylist()
                ids = lattice.sample(part.column("text").to_pylist(), row_seeds(keys, seed))
                cut = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(ids), pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of ``rows(doc_id, ids)``."""

    def run(batches):
        lattice = lattice_of(path, 1.0)
        for batch in batches:
            ids = batch.column("ids")
            texts = [lattice.decode(np.asarray(x.values.to_numpy())) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def op4_sampled_pieces(spark: SparkSession, sf_dir: str, seed: int = 0) -> DataFrame:
    """Sample a segmentation of every document, decode it, and digest both.

    Encoding and decoding share a pass, so that ids do not travel: n_pieces, ids_crc32 (little-endian
    unsigned 32-bit), text_crc32 of the decoded text in UTF-8, and whether it equals the document's.
    A row a document: a null text is an empty one and has no piece; repeated rows, and rows with a null doc_id, get the
    sample of their id and text each; a text is sampled whole, however long; an empty table has no rows.
    """
    path = tokenizer_path("piece_bpe_32k.model")

    def run(batches):
        lattice = lattice_of(path, 1.0)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                keys, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                rows = []
                for key, text, ids in zip(keys, texts, lattice.sample(texts, row_seeds(keys, seed)), strict=True):
                    back = lattice.decode(ids)
                    rows.append((key, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back.encode()), back == text))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["doc_id", "n_pieces", "ids_crc32", "text_crc32", "lossless"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return docs.mapInArrow(tidy(run), "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean")
