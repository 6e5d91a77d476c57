"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

A text is cut into units that no piece crosses (before a space that follows something else, and at line ends), units
are encoded once per task, and all units of one length advance together as rows of a matrix. At each end position
rolling hashes of the substrings that end there probe the sorted keys of the pieces, each piece found gets a score by
the path up to its start, and the vectorised maximum over the lengths is stored with its backpointer.

* unigram models: the score is that of the path plus the piece's.
* BPE models: their piece scores are merge ranks, so a sum of them isn't what the model encodes. What it encodes is the
  one path on which merging makes every piece from its own characters and leaves every two neighbours apart, so the
  score is whether the piece is apart from the last piece of the path at its start. Exactly one piece passes at each
  position. Two pieces are apart if, undoing their merges from the last to the first, no pair across the border would
  have been merged earlier than the merge undone.

Units over LONG characters are walked alone, with the same scores. Characters without a piece become byte pieces. The
ids are those of the public sentencepiece library for the model.

Defined cases: null and empty texts have no ids; the space mark U+2581 in a text decodes to a space, as in the public
library; unknown ids raise; repeated rows are encoded alike; an empty table gives no rows; extra columns of any name
are kept, but for those named like a column that is added, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Units that a task remembers; beyond it starts anew.
CACHE_UNITS = 400_000
LONG = 400
#: Cells of one matrix of units.
CELLS = 1 << 20
_UNITS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+")
_NONE = np.iinfo(np.int32).max
_BASE = np.uint64(0x100000001B3)
#: Bits of a hash that the sieve of the piece keys looks at; and of the table of pairs that are told apart or not, whose
#: slots are taken by the golden ratio.
_SIEVE, _KNOWN_BITS, _GOLDEN = np.uint64((1 << 20) - 1), 20, np.uint64(0x9E3779B97F4A7C15)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


def model_kind(raw: bytes) -> str:
    """The model type in the trainer_spec of a model file."""
    spec = b"".join(v for k, v in _fields(raw) if k == 2)
    kind = [v for k, v in _fields(spec) if k == 3]
    return {1: "unigram", 2: "bpe", 3: "word", 4: "char"}.get(kind[-1] if kind else 1, "?")


class PieceModel:
    """A model's pieces as arrays: small enough (a few MB for 32,000 pieces) to broadcast."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], byte_ids: list[int], kind: str, dummy_prefix: bool):
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"unknown kind of model {kind!r}")
        self.kind, self.dummy_prefix, self.size = kind, dummy_prefix, len(pieces)
        self.byte_ids = np.array(byte_ids, dtype=np.int32)
        node = {p: i for i, (p, ok) in enumerate(zip(pieces, normal, strict=True)) if ok}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in node):
            raise ValueError("pieces across spaces or line ends are not supported")
        for p in list(node):
            for c in p:
                node.setdefault(c, len(pieces) + len(node))  # characters that are only parts of pieces
        self.nodes = max(node.values(), default=0) + 1
        self.nodes = max(self.nodes, self.size)
        self.chars = {ord(p): i for p, i in node.items() if len(p) == 1}
        if kind == "bpe":
            self._rank_pairs(node, scores)
        real = [(p, i) for p, i in node.items() if (self.made[i] if kind == "bpe" else i < self.size)]
        self.longest = max((len(p) for p, _ in real), default=1)
        hashes = np.array([self._text_hash(p) for p, _ in real], dtype=np.uint64)
        by_hash = np.argsort(hashes)
        self.hashes = hashes[by_hash]
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        self.hash_piece = np.array([i for _, i in real], dtype=np.int32)[by_hash]
        self.sieve = np.zeros(int(_SIEVE) + 1, dtype=bool)
        self.sieve[self.hashes & _SIEVE] = True
        self.by_text = dict(real)
        self.scores = np.array(scores)
        self.unknown_score = min((scores[i] for _, i in real if i < self.size), default=0.0) - 10.0
        # Bytes of each piece when decoded.
        own = {b: k for k, b in enumerate(byte_ids)}
        raw = [bytes([own[i]]) if i in own else p.replace(MARK, " ").encode() if ok else b"" for i, (p, ok) in enumerate(zip(pieces, normal, strict=True))]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_size = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_at = np.append(0, np.cumsum(self.raw_size))[:-1]
        self._start()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("lookup", "cache", "lists", "flat", "at", "used", "known", "known_apart")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _start(self) -> None:
        self.lookup = np.arange(0x110000, dtype=np.int32) + self.nodes  # a character without a node stands for itself
        self.lookup[list(self.chars)] = list(self.chars.values())
        if self.kind == "bpe":  # what _two_apart() looks up
            a, b = np.divmod(self.pair_keys, self.nodes)
            self.lists = (self.rank.tolist(), self.left.tolist(), self.right.tolist(), dict(zip(zip(a.tolist(), b.tolist(), strict=True), self.pair_ranks.tolist(), strict=True)))
        # Pairs that are told apart or not: no pair has the key -1.
        self.known, self.known_apart = np.full(1 << _KNOWN_BITS, -1, dtype=np.int64), np.zeros(1 << _KNOWN_BITS, dtype=bool)
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.flat, self.at, self.used = np.zeros(1 << 16, dtype=np.int32), np.zeros(1, dtype=np.int64), 0

    @classmethod
    def load(cls, path: str = MODEL) -> PieceModel:
        """Read a model file with the public library; the driver does this once."""
        import sentencepiece

        raw = open(path, "rb").read()
        return cls.from_bytes(raw, sentencepiece.SentencePieceProcessor(model_proto=raw), model_kind(raw))

    @classmethod
    def from_bytes(cls, raw: bytes, sp, kind: str = "bpe") -> PieceModel:  # noqa: ANN001
        n = sp.get_piece_size()
        if sp.normalize("a ﬁ ").replace(MARK, " ") not in (" a ﬁ ", "a ﬁ "):
            raise ValueError("only models without text normalisation are supported")
        is_byte = [sp.is_byte(i) for i in range(n)]
        if sum(is_byte) != 256:
            raise ValueError("only models with byte fallback are supported")
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = [not (is_byte[i] or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], normal, byte_ids, kind, sp.normalize("x").startswith(MARK))

    @staticmethod
    def _text_hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    # -- merges of BPE models

    def _rank_pairs(self, node: dict[str, int], scores: list[float]) -> None:
        """Sorted keys of the pairs that merge, with their ranks; of each piece the rank and the parts of the merge that
        makes it (single characters have rank -1), and whether its own characters are merged to it."""
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in node.values() if i < self.size}, reverse=True))}
        keys, ranks, splits = [], [], {}
        for p, i in node.items():
            for k in range(1, len(p)):
                a, b = node.get(p[:k]), node.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.nodes + b)
                    ranks.append(order[scores[i]])
                    splits.setdefault(len(p), []).append((i, a, b))
        by_key = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys, self.pair_ranks = np.array(keys, dtype=np.int64)[by_key], np.array(ranks, dtype=np.int64)[by_key]
        self.rank, self.left, self.right = (np.full(self.nodes, -1, dtype=np.int64) for _ in range(3))
        self.made = np.zeros(self.nodes, dtype=bool)
        self.made[[i for p, i in node.items() if len(p) == 1]] = True
        for length in sorted(splits):  # parts are shorter, so they are known
            i, a, b = np.array(splits[length], dtype=np.int64).T
            own = self.made[a] & self.made[b]
            i, a, b = i[own], a[own], b[own]
            self.rank[i] = [order[scores[x]] for x in i.tolist()]
            good = self._apart(a, b, -1)
            self.left[i[good]], self.right[i[good]], self.made[i[good]] = a[good], b[good], True

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.pair_keys):
            return np.full(len(a), _NONE)
        keys = np.where((a < self.nodes) & (b < self.nodes), a * self.nodes + b, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def _rank_of(self, nodes: np.ndarray) -> np.ndarray:
        return np.where(nodes < self.nodes, self.rank[np.minimum(nodes, self.nodes - 1)], -1)

    def _apart(self, a: np.ndarray, b: np.ndarray, limit: int = _NONE) -> np.ndarray:
        """Whether merging leaves a and b side by side; a limit of -1 lets the pair itself be merged at last."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out, live, limits = np.ones(len(a), dtype=bool), np.arange(len(a)), np.full(len(a), limit, dtype=np.int64)
        while len(live):
            crossed = self._pair_rank(a, b) < limits
            out[live[crossed]] = False
            last_a, last_b = self._rank_of(a), self._rank_of(b)
            go = ~crossed & ((last_a >= 0) | (last_b >= 0))
            live, a, b, last_a, last_b = live[go], a[go], b[go], last_a[go], last_b[go]
            of_a = last_a > last_b  # of equal merges the left one comes first, so the right one is undone first
            limits = np.where(of_a, last_a, last_b + 1)
            a, b = np.where(of_a, self.right[np.where(of_a, a, 0)], a), np.where(of_a, b, self.left[np.where(of_a, 0, b)])
        return out

    def _known_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_apart(), by the answers that are known from earlier pairs: a table by a hash of the pair, in which a newer pair takes
        the place of an older one."""
        key = a.astype(np.int64) << np.int64(32) | b.astype(np.int64)
        slot = ((key.view(np.uint64) * _GOLDEN) >> np.uint64(64 - _KNOWN_BITS)).astype(np.int64)
        known = self.known[slot] == key
        out = self.known_apart[slot]
        if not known.all():
            new = np.flatnonzero(~known)
            pair, which = np.unique(key[new], return_inverse=True)
            apart = self._apart(pair >> np.int64(32), pair & np.int64(0xFFFFFFFF))[which]
            out[new] = apart
            self.known[slot[new]], self.known_apart[slot[new]] = key[new], apart
        return out

    # -- encoding

    def _lone(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the path of one long unit, walked a position at a time."""
        n, most, bpe = len(text), self.longest, self.kind == "bpe"
        last, size, best = np.zeros(n + 1, dtype=np.int32), np.zeros(n + 1, dtype=np.int32), [0.0] * (1 if bpe else n + 1)
        for end in range(1, n + 1):
            found = None
            for start in range(max(0, end - most), end):
                piece = self.by_text.get(text[start:end])
                if piece is None:
                    if start < end - 1:
                        continue
                    piece = int(self.lookup[ord(text[start])]) if bpe else ord(text[start]) + self.nodes
                if bpe:
                    if start == 0 or self._two_apart(int(last[start]), piece):
                        found = (start, piece)
                        break
                    continue
                score = best[start] + (float(self.scores[piece]) if piece < self.nodes else self.unknown_score)
                if found is None or score > best[end]:
                    found, best[end] = (start, piece), score
            last[end], size[end] = found[1], end - found[0]
        path, at = [], n
        while at:
            path.append(int(last[at]))
            at -= int(size[at])
        return np.array(path[::-1], dtype=np.int32), np.array([len(path)])

    def _two_apart(self, a: int, b: int) -> bool:
        """_apart() of one pair."""
        ranks, left, right, pairs = self.lists
        limit = _NONE
        while pairs.get((a, b), _NONE) >= limit:
            last_a, last_b = (ranks[x] if x < self.nodes else -1 for x in (a, b))
            if last_a < 0 and last_b < 0:
                return True
            if last_a > last_b:
                limit, a = last_a, right[a]
            else:
                limit, b = last_b + 1, left[b]
        return False

    def _viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of characters -> nodes of the best paths side by side, and how many each row has."""
        n, width = codes.shape
        bpe = self.kind == "bpe"
        best = np.full((width + 1, n), -np.inf)
        back = np.zeros((width + 1, n), dtype=np.int32)
        piece = np.zeros((width + 1, n), dtype=np.int32)
        best[0] = 0
        here = np.arange(n)
        hashes = np.zeros((0, n), dtype=np.uint64)  # of the substrings that end here, the longest first
        for end in range(1, width + 1):
            c = codes[:, end - 1].astype(np.uint64) + np.uint64(1)
            hashes = np.concatenate([hashes[-(self.longest - 1) :] * _BASE + c, c[None]]) if self.longest > 1 else c[None]
            starts = end - np.arange(len(hashes), 0, -1)
            length, row = np.nonzero(self.sieve[hashes & _SIEVE])  # few substrings pass that are no pieces
            probed = hashes[length, row]
            at = np.minimum(np.searchsorted(self.hashes, probed), len(self.hashes) - 1)
            is_piece = self.hashes[at] == probed
            length, row, own = length[is_piece], row[is_piece], self.hash_piece[at[is_piece]]
            if bpe:  # a single character is always a piece; of the pieces that end here one is apart from its last one
                several = length < len(hashes) - 1
                length, row = np.append(length[several], np.full(n, len(hashes) - 1)), np.append(row[several], here)
                own = np.append(own[several], self.lookup[codes[:, end - 1]])
                apart = self._known_apart(piece[starts[length], row], own) | (starts[length] == 0)
                length, row = length[apart][::-1], row[apart][::-1]  # the longest is written last
                back[end, row], piece[end, row] = starts[length], own[apart][::-1]
                continue
            hit, found = np.zeros(hashes.shape, dtype=bool), np.zeros(hashes.shape, dtype=np.int32)
            hit[length, row], found[length, row] = True, own
            score = best[starts] + np.where(hit, self.scores[np.minimum(found, self.size - 1)], -np.inf)
            lone = best[end - 1] + np.where(hit[-1], -np.inf, self.unknown_score)
            score[-1] = np.maximum(score[-1], lone)
            pick = score.argmax(axis=0)
            best[end], back[end] = score[pick, here], starts[pick]
            piece[end] = np.where(hit[pick, here], found[pick, here], codes[:, end - 1].astype(np.int32) + self.nodes)
        out = np.zeros((n, width), dtype=np.int32)
        at, slot, here = np.full(n, width), np.full(n, width), np.arange(n)
        while (live := at > 0).any():
            r = here[live]
            slot[r] -= 1
            out[r, slot[r]] = piece[at[r], r]
            at[r] = back[at[r], r]
        return out[np.arange(width) >= slot[:, None]], width - slot

    def _bytes(self, nodes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes to ids: what is no piece becomes the pieces of its bytes."""
        odd = nodes >= self.size
        if not odd.any():
            return nodes, sizes
        char = {i: c for c, i in self.chars.items() if i >= self.size}
        unique, which = np.unique(nodes[odd], return_inverse=True)
        raw = [chr(char.get(int(u), int(u) - self.nodes)).encode("utf-8", "replace") for u in unique]
        count = np.ones(len(nodes), dtype=np.int64)
        count[odd] = np.array([len(x) for x in raw])[which]
        out = np.repeat(nodes, count)
        out[np.repeat(odd, count)] = self.byte_ids[np.frombuffer(b"".join(raw[k] for k in which), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return out, np.bincount(owner, weights=count, minlength=len(sizes)).astype(np.int64)

    def _learn(self, units: list[str]) -> None:
        """Encode new units and remember them."""
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        for width, same in by_length.items():
            rows = max(1, CELLS // (width * self.longest))
            for i in range(0, len(same), rows):
                part = same[i : i + rows]
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(part), width)
                if width > LONG:
                    nodes, sizes = (np.concatenate(x) for x in zip(*map(self._lone, part), strict=True))
                else:
                    nodes, sizes = self._viterbi(codes)
                ids, sizes = self._bytes(nodes, sizes)
                need = self.used + len(ids)
                if need > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), dtype=np.int32)])
                self.flat[self.used : need] = ids
                ends = self.used + np.cumsum(sizes)
                first = len(self.at) - 1
                self.at = np.append(self.at, ends)
                self.used = need
                self.cache.update(zip(part, range(first, first + len(part)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts side by side, and how many each has."""
        prefix = MARK if self.dummy_prefix else ""
        units = [_UNITS.findall(prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        every = set(chain.from_iterable(units))
        if len(self.cache) + len(every) > CACHE_UNITS:
            self._forget()
        self._learn(list(every - self.cache.keys()))
        counts = np.array([len(x) for x in units], dtype=np.int64)
        index = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(units)), dtype=np.int64, count=int(counts.sum()))
        begin, size = self.at[index], self.at[index + 1] - self.at[index]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (ends - size), size) + np.arange(int(size.sum()))]
        before = np.append(0, ends)
        stop = np.cumsum(counts)
        return ids, before[stop] - before[stop - counts]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is not of this model")
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        raw = self.raw[np.repeat(self.raw_at[ids] - (ends - size), size) + np.arange(int(size.sum()))].tobytes()
        before = np.append(0, ends)
        out, at = [], 0
        for n in sizes.tolist():
            own = raw[before[at] : before[at + n]]
            at += n
            out.append((own[1:] if self.dummy_prefix and own[:1] == b" " else own).decode("utf-8", "replace"))
        return out


def encode(docs: DataFrame, model: PieceModel, text: str = "text", keep_text: bool = True, check: bool = False, into: str = "__ids") -> DataFrame:
    """docs with __ids (array of int); with check also __same, whether decoding gives the text back."""
    fields = [f for f in docs.schema if (keep_text or f.name != text) and f.name not in (into, *["__same"] * check)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            names = batch.schema.names
            keep = [names.index(f.name) for f in fields]
            column = batch.column(names.index(text))
            for a, b in common.steps([len(t) for t in common.texts(batch, text)]):
                part = batch.slice(a, b - a)
                strings = [t or "" for t in column.slice(a, b - a).to_pylist()]
                ids, sizes = own.encode(strings)
                offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                new = [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))]
                if check:
                    new.append(pa.array([x == t.replace(MARK, " ") for x, t in zip(own.decode(ids, sizes), strings, strict=True)]))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], *new], names=[*[names[i] for i in keep], into, *["__same"] * check])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    return docs.mapInArrow(run, ", ".join([*kept, f"`{into}` array<int>", *["`__same` boolean"] * check]))


def decode(df: DataFrame, model: PieceModel, ids: str = "ids", into: str = "text") -> DataFrame:
    """df with the ids decoded; null ids give a null text, null elements raise."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index(ids))
            flat = column.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            out = shared.value.decode(flat.to_numpy(zero_copy_only=False), sizes)
            out = [t if ok else None for t, ok in zip(out, column.is_valid().to_pylist(), strict=True)]
            keep = [i for i, n in enumerate(names) if n != into]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(out, pa.string())], names=[*[names[i] for i in keep], into])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != into]
    return df.mapInArrow(run, ", ".join([*kept, f"`{into}` string"]))


def query(spark: SparkSession, sf_dir: str, path: str = MODEL) -> DataFrame:
    """op8_sentencepiece: the ids of every document, and whether they decode to its text."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, PieceModel.load(path), keep_text=False, check=True)
    return out.select("doc_id", F.size("__ids").cast("long").alias("n_tokens"), F.col("__ids").alias("ids"), F.col("__same").alias("round_trip"))
