"""Cross-tokenizer alignment by segment deduplication.

Texts are cut before white-space runs where neither vocabulary can merge across:
no entry of either holds other characters followed by that white space. So both
tokenisers end a token at every cut, and segments can be tokenised and aligned
alone. Blocks of documents become codes into their own lists of distinct
segments; equal segments of all blocks meet, are tokenised and aligned once, and
their alignments go back to the blocks, where documents are composed from codes.
Texts never travel, only distinct segments do.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import map_arrow
from tidemark.session import cut, drop_cut

#: White space before which a text may be cut, if the vocabularies allow it.
WHITE = " \n\t\x0b\x0c\r"
#: Characters of a block of documents; a longer document is a block of its own. Answers packed at once.
BLOCK_CHARS, FLUSH_ROWS = 1 << 24, 65_536
#: Documents times pairs of a block that are marked at once.
MARKS = 8_000_000
#: Fixed value: the split before byte-level merges.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Protobuf: an appended message overrides the model's own setting; here add_dummy_prefix of the normalizer is off.
NO_PREFIX = b"\x1a\x02\x18\x00"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest counted on from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def entries_of(first: bytes) -> dict[int, bytes]:
    """The bytes of each id of a byte-level vocabulary, special tokens left out."""
    model, alphabet = json.loads(first), byte_alphabet()
    special = {t["content"] for t in model["added_tokens"] if t["special"]}
    return {i: bytes(alphabet[c] for c in token) for token, i in model["model"]["vocab"].items() if token not in special}


def ranked(first: bytes) -> tiktoken.Encoding | None:
    """The same vocabulary for a faster library, if that gives the same ids: ids are the ranks of the merges, and the split is the plain byte-level one."""
    model = json.loads(first)
    vocab, merges, before = model["model"]["vocab"], model["model"]["merges"], model["pre_tokenizer"]
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    in_order = all(vocab[token] == 256 + rank for rank, token in enumerate(joined))
    plain = before and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    if not in_order or not plain or model["normalizer"] or any(not t["special"] for t in model["added_tokens"]):
        return None
    ranks = {token: i for i, token in entries_of(first).items()}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class Pair:
    """Both tokenisers, the bytes of their tokens, and where texts may be cut."""

    def __init__(self, first: bytes, second: bytes):
        self.a = Tokenizer.from_buffer(first)
        self.a.encode_special_tokens = True
        self.ranks = ranked(first)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second + NO_PREFIX)
        self.a_bytes = entries_of(first)
        self.b_bytes = {i: self._piece(i) for i in range(self.b.get_piece_size())}
        self.a_len, self.b_len = (byte_lengths(x) for x in (self.a_bytes, self.b_bytes))
        self.white = cut_points(self.a_bytes.values(), self.b_bytes.values())
        self.segments = cutter(self.white)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokenised(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        if self.ranks is not None:
            first = [self.ranks.encode_ordinary(x) for x in segments]
        else:
            first = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        return first, self.b.encode(segments, num_threads=1)

    def faithful(self, segment: str, a: list[int], b: list[int]) -> bool:
        data = segment.encode()
        return b"".join([self.a_bytes[i] for i in a]) == data == b"".join([self.b_bytes[i] for i in b])

    def aligned(self, segments: list[str]) -> pa.Array:
        """Each segment's groups in packed form (see ``packed``), null where the bytes are not the segment's."""
        all_a, all_b = self.tokenised(segments)
        ids_a, ids_b = list(chain.from_iterable(all_a)), list(chain.from_iterable(all_b))
        data = "".join(segments).encode()
        ok = None
        if not b"".join([self.a_bytes[i] for i in ids_a]) == data == b"".join([self.b_bytes[i] for i in ids_b]):
            ok = [self.faithful(*x) for x in zip(segments, all_a, all_b)]
            all_a, all_b = (list(compress(x, ok)) for x in (all_a, all_b))
            ids_a, ids_b = list(chain.from_iterable(all_a)), list(chain.from_iterable(all_b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (all_a, all_b))
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        found = packed(n_a, n_b, ids_a, ids_b, np.cumsum(self.a_len[ids_a]), np.cumsum(self.b_len[ids_b]))
        if ok is None:
            return found
        place = np.cumsum(ok) - 1
        return found.take(pa.array(np.where(ok, place, 0), mask=~np.array(ok)))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... (size of them) one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of values, runs of these sizes one after another."""
    upto, ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)]), np.cumsum(sizes)
    return (upto[ends] - upto[ends - sizes]).astype(np.int64)


def packed(n_a: np.ndarray, n_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> pa.Array:
    """Segments as 32-bit integers: n_groups, n_a, n_b, then sizes in a and b of each group, then the ids of a, then of b.

    A group ends at each byte offset where tokens of both end; all segments do.
    """
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    size_a, size_b = (np.bincount(np.searchsorted(common, e), minlength=len(common)) for e in (ends_a, ends_b))
    of_group = np.searchsorted(ends_a[np.cumsum(n_a) - 1], common) if len(n_a) else common
    n_groups = np.bincount(of_group, minlength=len(n_a))
    size = 3 + 2 * n_groups + n_a + n_b
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), "<i4")
    out[start], out[start + 1], out[start + 2] = n_groups, n_a, n_b
    at = ranges(start + 3, 2 * n_groups)[::2]
    out[at], out[at + 1] = size_a, size_b
    out[ranges(start + 3 + 2 * n_groups, n_a)] = ids_a
    out[ranges(start + 3 + 2 * n_groups + n_a, n_b)] = ids_b
    offsets = pa.py_buffer(np.concatenate([np.zeros(1, np.int32), 4 * np.cumsum(size)]).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(size), [None, offsets, pa.py_buffer(out.tobytes())])


def flat(segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many integers each packed segment has, 0 for a null one, and all of them."""
    if not len(segments):
        return np.zeros(0, np.int64), np.zeros(0, "<i4")
    _, offsets, data = segments.buffers()
    ends = np.frombuffer(offsets, np.int32)[segments.offset : segments.offset + len(segments) + 1].astype(np.int64)
    return np.diff(ends) // 4, np.frombuffer(data, "<i4")[ends[0] // 4 : ends[-1] // 4] if data else np.zeros(0, "<i4")


class Unpacked:
    """Packed segments as flat arrays; null ones are without tokens and ``lost``."""

    def __init__(self, segments: pa.Array):
        size, data = flat(segments)
        self.lost = size == 0
        start = (np.cumsum(size) - size)[~self.lost]
        self.n_groups, self.n_a, self.n_b = (np.zeros(len(segments), np.int64) for _ in range(3))
        for k, x in enumerate((self.n_groups, self.n_a, self.n_b)):
            x[~self.lost] = data[start + k]
        whole = np.zeros(len(segments), np.int64)
        whole[~self.lost] = start + 3
        at = ranges(whole, 2 * self.n_groups)[::2]
        self.size_a, self.size_b = data[at].astype(np.int64), data[at + 1].astype(np.int64)
        self.a = data[ranges(whole + 2 * self.n_groups, self.n_a)].astype(np.int64)
        self.b = data[ranges(whole + 2 * self.n_groups + self.n_a, self.n_b)].astype(np.int64)
        links = self.size_a * self.size_b
        of_group = np.repeat(np.arange(len(segments)), self.n_groups)
        self.n_links = np.bincount(of_group, links, len(segments)).astype(np.int64)

    def links(self) -> np.ndarray:
        """The linked pairs of ids of all segments in order, each as a times 2^32 plus b."""
        n = self.size_a * self.size_b
        k = ranges(np.zeros(len(n), np.int64), n)
        first_a, first_b = (np.repeat(np.cumsum(x) - x, n) for x in (self.size_a, self.size_b))
        wide = np.repeat(self.size_b, n)
        return self.a[first_a + k // wide] << 32 | self.b[first_b + k % wide]

    def shown(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of each segment."""

        def joined(items: pa.Array, sizes: np.ndarray, by: str) -> pa.Array:
            offsets = pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]).astype(np.int32))
            return pa.compute.binary_join(pa.ListArray.from_arrays(offsets, items), by)

        sides = [joined(pa.array(ids).cast(pa.string()), sizes, ",") for ids, sizes in ((self.a, self.size_a), (self.b, self.size_b))]
        return joined(pa.compute.binary_join_element_wise(*sides, "|"), self.n_groups, ";").cast(pa.binary()).to_pylist()


def byte_lengths(tokens: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(tokens) + 1, np.int64)
    for i, token in tokens.items():
        out[i] = len(token)
    return out


def cut_points(*vocabularies) -> str:
    """The white space that follows no other character in any entry."""
    inside = set()
    for entries in vocabularies:
        for token in entries:
            if len(token) > 1:
                # the bytes of half a character are no white space
                inside |= set(re.findall(f"\\S([{WHITE}])", token.decode(errors="replace")))
    return "".join(w for w in WHITE if w not in inside)


def cutter(white: str) -> Callable[[str], list[str]]:
    """Cuts a text before runs of ``white`` that follow anything but white space of any kind."""
    if not white:
        return lambda text: [text]
    chars = "".join(map(re.escape, white))
    # white space that allows no cut stays, with what follows it, with what stands before
    return re.compile(rf"\s*\S+(?:[^\S{chars}]\s*\S*)*|\s+").findall


def load(path: str) -> bytes:
    """A tokeniser's file; the driver reads it and the tasks parse it."""
    with open(path, "rb") as f:
        return f.read()


def numbering() -> defaultdict:
    """Numbers segments as they are first looked up."""
    return defaultdict(count().__next__)


def squeezed(codes: np.ndarray) -> bytes:
    """Codes by place of their bytes, compressed: frequent segments have small codes."""
    return pa.compress(np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def restored(data: bytes, n: int) -> np.ndarray:
    plain = np.frombuffer(pa.decompress(data, 4 * n, "zstd"), np.uint8)
    return np.ascontiguousarray(plain.reshape(4, -1).T).view("<i4").ravel()


def blocks(docs: DataFrame, pair: Callable[[], Pair], id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents: block, ids, lens (segments of each document), codes (of all segments, squeezed) and segs (what the codes stand for).

    The number of a block is drawn where it is written, so it must be written
    once before it is used.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_up, block = pair().segments, TaskContext.get().partitionId() << 33
        ids: list[pa.Array] = []
        lens, codes, known, chars = [], array("i"), numbering(), 0

        def closed() -> pa.RecordBatch:
            nonlocal ids, lens, codes, known, chars, block
            all_ids = pa.concat_arrays(ids)
            out = {
                "block": pa.array([block], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids),
                "lens": pa.array([lens], pa.list_(pa.int32())),
                "codes": pa.array([squeezed(np.array(codes, np.int32))], pa.binary()),
                "segs": pa.array([list(known)], pa.list_(pa.string())),
            }
            ids, lens, codes, known, chars, block = [], [], array("i"), numbering(), 0, block + 1
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            texts = batch.column(1)
            for at in range(batch.num_rows):
                text = texts[at].as_py()
                ids.append(batch.column(0).slice(at, 1))
                own = cut_up(" " + text) if text else []
                lens.append(len(own))
                codes.extend(map(known.__getitem__, own))
                chars += len(text or "") + 16
                if chars >= BLOCK_CHARS:
                    yield closed()
        if ids:
            yield closed()

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"block long, ids array<{kind.simpleString()}>, lens array<int>, codes binary, segs array<string>"
    )


class Packed:
    """Packed segments as they travel, each kind of figure squeezed by itself: groups of each segment (0 for a null one), sizes of groups, ids."""

    FIELDS = ("n_groups", "sizes", "tokens")

    @staticmethod
    def put(segments: pa.Array) -> dict:
        size, data = flat(segments)
        start = (np.cumsum(size) - size)[size > 0]
        n_groups = np.zeros(len(size), np.int64)
        n_groups[size > 0] = groups = data[start].astype(np.int64)
        ids = size[size > 0] - 3 - 2 * groups
        parts = n_groups, data[ranges(start + 3, 2 * groups)], data[ranges(start + 3 + 2 * groups, ids)]
        return {"n": len(segments), **{name: squeezed(x) for name, x in zip(Packed.FIELDS, parts)}}

    @staticmethod
    def get(n: int, n_groups: bytes, sizes: bytes, tokens: bytes) -> pa.Array:
        groups = restored(n_groups, n).astype(np.int64)
        each = restored(sizes, 2 * int(groups.sum())).astype(np.int64)
        n_a, n_b = sums(each[::2], groups), sums(each[1::2], groups)
        size = np.where(groups > 0, 3 + 2 * groups + n_a + n_b, 0)
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), "<i4")
        there = groups > 0
        out[start[there]], out[start[there] + 1], out[start[there] + 2] = groups[there], n_a[there], n_b[there]
        out[ranges(start + 3, 2 * groups)] = each
        out[ranges(start + 3 + 2 * groups, n_a + n_b)] = restored(tokens, int((n_a + n_b).sum()))
        offsets = np.concatenate([np.zeros(1, np.int64), 4 * np.cumsum(size)]).astype(np.int32)
        valid = np.packbits(there, bitorder="little").tobytes()
        return pa.Array.from_buffers(pa.binary(), n, [pa.py_buffer(valid), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


#: Columns of packed segments.
PACKED = ", ".join(f"{c} binary" for c in Packed.FIELDS)


def answers(tiles: DataFrame, pair: Callable[[], Pair]) -> DataFrame:
    """What the codes of each block stand for: block, n, codes and packed segments, some of a block's codes in a row.

    All blocks that ask for a segment meet in a task, sorted, so each segment
    is tokenised and aligned once. A block asks once for a segment, so no key
    has more rows than there are blocks.
    """
    asked = tiles.select("block", F.posexplode("segs").alias("code", "seg")).repartition("seg").sortWithinPartitions("seg")
    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("codes", pa.binary()), *((c, pa.binary()) for c in Packed.FIELDS)])

    def told(held: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> pa.RecordBatch:
        of_block, code = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        order = np.lexsort((code, of_block))
        groups = pa.concat_arrays([x[2] for x in held]).take(pa.array(order))
        of_block, code = of_block[order], code[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(of_block)) + 1, [len(of_block)]])
        rows = [{"block": int(of_block[a]), "codes": squeezed(code[a:b]), **Packed.put(groups[a:b])} for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, last, last_groups, held, n = None, None, None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            both = both or pair()
            segs = batch.column(2)
            fresh = np.ones(len(segs), bool)
            fresh[0] = last is None or segs[0].as_py() != last
            fresh[1:] = pa.compute.not_equal(segs[1:], segs[:-1]).to_numpy(zero_copy_only=False)
            new = segs.filter(pa.array(fresh)).to_pylist()
            known = both.aligned(new) if new else pa.array([], pa.binary())
            if not fresh[0]:
                known = pa.concat_arrays([last_groups, known])
            groups = known.take(pa.array(np.cumsum(fresh) - fresh[0]))
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), groups))
            last, last_groups, n = segs[-1].as_py(), groups[-1:], n + len(segs)
            if n >= FLUSH_ROWS:
                yield told(held)
                held, n = [], 0
        if held:
            yield told(held)

    return asked.mapInArrow(run, f"block long, n int, codes binary, {PACKED}")


class Block:
    """One block's documents as codes, with its segments unpacked in order of their codes."""

    def __init__(self, lens: np.ndarray, codes: bytes, groups: pa.Array):
        self.lens = lens.astype(np.int64)
        self.codes = restored(codes, int(self.lens.sum()))
        self.known = Unpacked(groups)
        lost = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.known.lost[self.codes])])
        self.ends = np.cumsum(self.lens)
        self.whole = (self.lens > 0) & (lost[self.ends] == lost[self.ends - self.lens])

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs of the block, and in how many of its documents each is."""
        pairs, pair = np.unique(self.known.links(), return_inverse=True)
        n, docs = self.known.n_links, np.zeros(len(pairs), np.int64)
        first, starts = np.cumsum(n) - n, self.ends - self.lens
        step = max(1, MARKS // max(1, len(pairs)))
        for at in range(0, len(self.lens), step):
            whole, lens = self.whole[at : at + step], self.lens[at : at + step]
            codes = self.codes[ranges(starts[at : at + step][whole], lens[whole])]
            doc = np.repeat(np.repeat(np.arange(len(lens)), np.where(whole, lens, 0)), n[codes])
            held = np.zeros((len(lens), len(pairs)), bool)
            held[doc, pair[ranges(first[codes], n[codes])]] = True
            docs += held.sum(axis=0)
        return pairs[docs > 0], docs[docs > 0]


def answered(tiles: DataFrame, told: DataFrame) -> DataFrame:
    """The blocks with their answers in order of codes, n of them, and with pairs and docs, the documents of the block that hold a pair."""
    ids = tiles.schema["ids"].dataType
    asking = tiles.select("block", F.lit(0).alias("part"), "ids", "lens", F.lit(0).alias("n"), "codes", *[F.lit(None).cast("binary").alias(c) for c in Packed.FIELDS])
    giving = told.select("block", F.lit(1).alias("part"), F.lit(None).cast(ids).alias("ids"), F.lit(None).cast("array<int>").alias("lens"), "n", "codes", *Packed.FIELDS)
    rows = asking.unionByName(giving).repartition("block").sortWithinPartitions("block", "part")

    def whole(head: dict, parts: list[dict]) -> pa.RecordBatch:
        codes = np.concatenate([np.zeros(0, np.int32), *[restored(x["codes"], x["n"]) for x in parts]])
        groups = pa.concat_arrays([pa.array([], pa.binary()), *[Packed.get(x["n"], *[x[c] for c in Packed.FIELDS]) for x in parts]]).take(pa.array(np.argsort(codes)))
        pairs, docs = Block(head["lens"].values.to_numpy(), head["codes"], groups).pair_counts()
        packed_ = Packed.put(groups)
        return pa.RecordBatch.from_pydict({
            "block": [head["block"]], "ids": pa.ListArray.from_arrays(pa.array([0, len(head["ids"].values)], pa.int32()), head["ids"].values),
            "lens": pa.array([head["lens"].as_py()], pa.list_(pa.int32())), "codes": pa.array([head["codes"]], pa.binary()), "n": pa.array([packed_["n"]], pa.int32()),
            **{c: pa.array([packed_[c]], pa.binary()) for c in Packed.FIELDS},
            "pairs": pa.array([pairs], pa.list_(pa.int64())), "docs": pa.array([docs], pa.list_(pa.int64())),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column(1)[row].as_py() == 0:
                    if head is not None:
                        yield whole(head, parts)
                    head = {"block": batch.column(0)[row].as_py(), "ids": batch.column(2)[row], "lens": batch.column(3)[row], "codes": batch.column(5)[row].as_py()}
                    parts = []
                else:
                    parts.append({"n": batch.column(4)[row].as_py(), "codes": batch.column(5)[row].as_py(), **{c: batch.column(6 + k)[row].as_py() for k, c in enumerate(Packed.FIELDS)}})
        if head is not None:
            yield whole(head, parts)

    schema = f"block long, ids {ids.simpleString()}, lens array<int>, codes binary, n int, {PACKED}, pairs array<long>, docs array<long>"
    return rows.mapInArrow(run, schema)


def corpus_counts(counts: DataFrame) -> DataFrame:
    """pair, docs over the corpus, and whether that is the highest of the pair's first id."""
    total = counts.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", 32))
    best = total.groupBy("a").agg(F.max("docs").alias("most"))
    return total.join(best, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def compose(tiles: DataFrame, id_col: str, groups: bool) -> DataFrame:
    """Documents from the codes of their blocks and the counts of the blocks' pairs."""
    kind = tiles.schema["ids"].dataType.elementType

    def step(t: pa.Table) -> pa.Table:
        lens, codes, *parts, pairs = (t.column(c)[0] for c in range(1, t.num_columns))
        block = Block(lens.values.to_numpy(), codes.as_py(), Packed.get(*[x.as_py() for x in parts]))
        known = block.known
        values = {c: getattr(known, c) for c in ("n_a", "n_b", "n_groups", "n_links")}
        if pairs.is_valid:
            keys, docs, best = (x.to_numpy(zero_copy_only=False) for x in pairs.values.flatten())
            order = np.argsort(keys)
            links = known.links()
            place = order[np.minimum(np.searchsorted(keys, links, sorter=order), len(keys) - 1)]
            counted = keys[place] == links  # links of documents without tokens may be counted nowhere
            n = known.n_links
            values |= {"n_best": sums(np.where(counted & best[place], 1, 0), n), "count_sum": sums(np.where(counted, docs[place], 0), n)}
        columns = {id_col: t.column(0)[0].values}
        for name in NUMBERS:
            each = values.get(name, np.zeros(len(known.lost), np.int64))
            columns[name] = pa.array(np.where(block.whole, sums(each[block.codes], block.lens), 0))
        shown, digests, texts = known.shown(), [], []
        for n, end, ok in zip(block.lens.tolist(), block.ends.tolist(), block.whole.tolist()):
            text = b";".join([shown[c] for c in block.codes[end - n : end].tolist()]) if ok else b""
            digests.append(hashlib.sha256(text).hexdigest() if ok else "")
            if groups:
                texts.append(text.decode())
        columns["groups_sha256"] = digests
        if groups:
            columns["groups"] = texts
        return pa.table(columns)

    schema = f"`{id_col}` {kind.simpleString()}, " + ", ".join(f"{c} long" for c in NUMBERS) + ", groups_sha256 string" + ", groups string" * groups
    return map_arrow(tiles.select("ids", "lens", "codes", "n", *Packed.FIELDS, "pairs"), step, schema, 1)


def align(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """Token ids of two tokenisers over every whole text, aligned by byte offsets.

    ``first_path`` is a byte-level BPE, which reads a space and the text,
    ``second_path`` a piece model with byte fallback, which adds that space.
    Offsets where both end a token cut the tokens into groups; all pairs of
    tokens of a group are linked. Returns id_col, n_a and n_b (tokens),
    n_groups, n_links, n_best (links whose number of documents is the highest
    of their first id, ties included), count_sum (that number over all links)
    and groups_sha256, of ``a1,a2|b1;a3|b2``; with ``groups=True`` that text.

    Null and empty texts, and texts whose bytes a tokeniser does not give back,
    have no tokens: zeros, and '' for the digest; they count in no pair.
    Special tokens' strings are plain text. Each row is a document, repeated
    rows and ids too, null ids are kept. Other columns are left out. An empty
    table gives no rows. A task holds one block of documents, BLOCK_CHARS or
    one longer text, or one longest segment.
    """
    first, second = load(first_path), load(second_path)

    def pair() -> Pair:
        return Pair(first, second)

    coded = cut(blocks(docs, pair, id_col, text_col), "crosstok-blocks", "zstd")
    tiles = cut(answered(coded, answers(coded, pair)), "crosstok-answered", "zstd")
    drop_cut(coded)
    counts = tiles.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("x.pairs", "x.docs").withColumnRenamed("pairs", "pair")
    asked = tiles.select("block", F.explode("pairs").alias("pair")).join(corpus_counts(counts), "pair")
    pairs = asked.groupBy("block").agg(F.collect_list(F.struct("pair", "docs", "best")).alias("pairs"))
    return compose(tiles.drop("pairs", "docs").join(pairs, "block", "left"), id_col, groups)
