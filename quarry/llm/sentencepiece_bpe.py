"""Operator 2: SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Chance that a candidate merge is skipped.
DROPOUT, SEED = 0.1, 17
#: Courses of units a worker keeps before it starts its cache anew.
CACHE = 500_000
#: Occurrences that are followed through the cache at once.
CHUNK = 1 << 15
#: Longer units go through a heap, shorter ones through a table of many units at once (the same
#: order). A unit of n characters has less than 3 n candidates, so that a course fits in 63 bits.
SCAN = 20

_MASK, _NONE = (1 << 64) - 1, 1 << 62
#: Bits of a piece's id beside its rank; the parts of numbers that hold both.
_BITS = 24
_PIECE, _SYMBOL = (1 << _BITS) - 1, (1 << 32) - 1
# odd constants that keys of candidates and of occurrences are made with
_AT, _LEFT, _RANK, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0xA0761D6478BD642F
_SPACE = "▁"


def load_pieces(model_path: str | None = None) -> list[tuple[str, int, float]]:
    """(piece, type, score) by id of a SentencePiece model; types: 1 normal, 2 unknown, 3 control, 6 byte."""
    import sentencepiece

    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=str(model_path))
    kind = lambda i: 2 if m.is_unknown(i) else 3 if m.is_control(i) else 6 if m.is_byte(i) else 1
    return [(m.id_to_piece(i), kind(i), m.get_score(i)) for i in range(m.get_piece_size())]


_PLAIN = re.compile(" *[^ \n▁]+| +|\n|▁")


def unit_pattern(pieces: list[str]) -> tuple[re.Pattern, re.Pattern | None]:
    """A pattern of units that no merge crosses: line ends, and words and runs of signs (punctuation,
    symbols, controls) with the spaces before them; and one of the few characters that pieces join
    with signs: a text that has them is cut at spaces and line ends only."""
    signs = {c for p in pieces for c in p if c not in (_SPACE, "\n") and unicodedata.category(c)[0] in "PSC"}
    mixed = {c for p in pieces for a, b in pairwise(p.lstrip(_SPACE)) if (a in signs) != (b in signs) for c in (a, b) if c not in signs}
    if not signs or len(mixed) > 8:
        return _PLAIN, None
    chars = "".join(re.escape(c) for c in sorted(signs))
    return re.compile(f" *[^ \n▁{chars}]+| *[{chars}]+| +|\n|▁"), re.compile("[" + "".join(map(re.escape, sorted(mixed))) + "]") if mixed else None


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(29))) * np.uint64(_RANK)


class MergeEncoder:
    """Encodes and decodes texts with the merges of a BPE model with byte fallback, whose scores order its merges.

    The agenda holds the adjacent pairs that form a piece, best score first, then leftmost. A
    pair that comes up is skipped when the keyed hash of (seed, document, occurrence, place,
    pieces) falls under the dropout; it is not tried again, and later merges go on without it.

    What a unit becomes depends on which of its candidates are skipped, in the order they come
    up: its course, a bit mask of skipped candidates. A node of the cache is a unit and a course
    after whose last skip nothing is skipped any more: the ids that it ends in, and the keys of the
    candidates that come up after that skip. Each occurrence hashes those with its own key; the
    first one that it skips leads to another node.
    """

    def __init__(self, pieces: list[tuple[str, int, float]], dropout: float = DROPOUT, seed: int = SEED):
        self.ids = {p: i for i, (p, kind, _) in enumerate(pieces) if kind == 1}
        self.rank = {p: r for r, p in enumerate(sorted(self.ids, key=lambda p: (-pieces[self.ids[p]][2], self.ids[p])))}
        self.units, self.mixed = unit_pattern(list(self.ids))
        self.bytes = {int(p[3:5], 16): i for i, (p, kind, _) in enumerate(pieces) if kind == 6}
        self.raw = [bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(_SPACE, " ").encode() if kind == 1 else b"" for p, kind, _ in pieces]
        self.limit, self.seed = min(_MASK, int(dropout * 2**64)), seed
        self.keys: np.ndarray | None = None
        self.clear()

    def clear(self) -> None:
        """Forget all nodes."""
        self.roots: dict[str, int] = {}
        self.root_units: list[str] = []
        #: Of each node: its unit (a place in root_units), course, and where its ids and candidates begin and how many there are.
        self.nodes = 0
        self.unit_of, self.masks = np.zeros(1024, np.int32), np.zeros(1024, np.uint64)
        self.id_starts, self.id_counts = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.starts, self.counts = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.made, self.made_used = np.zeros(4096, np.int32), 0
        self.candidates, self.used = np.zeros(4096, np.uint64), 0
        #: Sorted (node << 6 | skipped candidate) and the nodes they lead to.
        self.turns, self.turned = np.empty(0, np.int64), np.empty(0, np.int64)

    def occurrence_keys(self, document: int, n: int) -> np.ndarray:
        """The keys of a document's n units."""
        start = xxhash.xxh3_64_intdigest(document.to_bytes(8, "little", signed=True), self.seed)
        return _mixed(np.uint64(start) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP))

    def _skip(self, key: int, at: int, left: int, rank: int) -> bool:
        """Whether an occurrence skips the candidate at a place, of a left part so long and a piece of that rank."""
        x = (key ^ (at * _AT + left * _LEFT + rank * _RANK)) & _MASK
        x = (x ^ (x >> 31)) * 0x94D049BB133111EB & _MASK
        return (x ^ (x >> 29)) * _RANK & _MASK < self.limit

    def _heap(self, word: str, key: int) -> list[str]:
        n, rank = len(word), self.rank
        parts: list[str | None] = list(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(agenda, (r, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            r, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right or self.limit and self._skip(key, i, len(left), r):
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _pairs(self) -> None:
        """Tables of the candidate merges: sorted keys of (left, right) symbols, and ranks with the merged symbols.

        Symbols are the ids of pieces; self.other stands for a character outside the vocabulary,
        the number after it for no symbol at all.
        """
        self.other = len(self.raw)
        self.base = self.other + 2
        found = [(self.ids[p[:i]] * self.base + self.ids[p[i:]], self.rank[p] << _BITS | self.ids[p]) for p in self.ids for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids]
        table = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.keys, self.merges = (np.ascontiguousarray(table[:, i]) for i in range(2))
        self.symbol = np.full(0x110000, self.other, np.int64)
        self.lengths = np.ones(self.base, np.int64)
        for p, i in self.ids.items():
            self.lengths[i] = len(p)
            if len(p) == 1:
                self.symbol[ord(p)] = i

    def _merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank and merged symbol of pairs of symbols as one number, _NONE where they do not merge."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merges[at], _NONE)

    def courses(self, words: list[str], masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of up to SCAN characters under courses, merged side by side: their ids and the number of
        each, and the keys of the candidates after each course's last skip and the number of each."""
        if self.keys is None:
            self._pairs()
        n, gone = len(words), self.other + 1
        sizes = np.fromiter(map(len, words), np.int64, n)
        width = int(sizes.max())
        symbols = np.full((n, width + 1), gone, np.int64)
        columns = np.arange(width + 1)
        symbols[columns < sizes[:, None]] = self.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        # a cell is a place and a symbol; a merge a rank and a symbol: both in one number
        cell = columns << 32 | symbols
        merge = self._merge_of(symbols[:, :-1], symbols[:, 1:])
        final = np.empty_like(symbols)
        rows = live = np.arange(n)
        free: list[tuple[np.ndarray, np.ndarray]] = []
        masks, turn = masks.copy(), 0
        while True:
            at = merge.argmin(1)
            best = merge[rows, at]
            done = best == _NONE
            if done.any():
                final[live[done]] = cell[done] & _SYMBOL
                keep = np.flatnonzero(~done)
                if not len(keep):
                    break
                live, cell, masks, merge, at, best = live[keep], cell[keep], masks[keep], merge[keep], at[keep], best[keep]
                rows = np.arange(len(live))
            here = cell[rows, at]
            left = masks >> np.uint64(turn)
            turn += 1
            after = np.flatnonzero(left == 0)
            if len(after):
                x = here[after]
                key = (x >> 32).astype(np.uint64) * np.uint64(_AT) + self.lengths[x & _SYMBOL].astype(np.uint64) * np.uint64(_LEFT) + (best[after] >> _BITS).astype(np.uint64) * np.uint64(_RANK)
                free.append((live[after], key))
            skip = (left & np.uint64(1)).astype(bool)
            if skip.any():
                merge[rows[skip], at[skip]] = _NONE
                go = np.flatnonzero(~skip)
                if not len(go):
                    continue
                j, best, here, c, m = at[go], best[go], here[go], cell[go], merge[go]
            else:
                go, j, c, m = rows, at, cell, merge
            moved = np.full_like(c, gone)
            moved[:, :-1] = c[:, 1:]
            c = np.where(columns <= j[:, None], c, moved)
            moved = np.full_like(m, _NONE)
            moved[:, :-1] = m[:, 1:]
            m = np.where(columns[:-1] <= j[:, None], m, moved)
            k = np.arange(len(go))
            new = best & _PIECE
            c[k, j] = here >> 32 << 32 | new
            m[k, j] = self._merge_of(new, c[k, j + 1] & _SYMBOL)
            back = np.flatnonzero(j > 0)
            m[back, j[back] - 1] = self._merge_of(c[back, j[back] - 1] & _SYMBOL, new[back])
            if go is rows:
                cell, merge = c, m
            else:
                cell[go], merge[go] = c, m
        held = final != gone
        values, sizes = final[held].astype(np.int32), held.sum(1)
        odd = np.flatnonzero((final == self.other).any(1))
        if len(odd):  # characters outside the vocabulary become bytes
            parts = np.split(values, np.cumsum(sizes)[:-1])
            for i in odd.tolist():
                chars, ids = iter([ch for ch in words[i] if self.symbol[ord(ch)] == self.other]), []
                for x in parts[i].tolist():
                    ids.extend((x,) if x != self.other else (self.bytes[v] for v in next(chars).encode("utf-8", "surrogatepass")))
                parts[i] = np.array(ids, np.int32)
                sizes[i] = len(ids)
            values = np.concatenate(parts)
        owner = np.concatenate([f[0] for f in free]) if free else np.empty(0, np.int64)
        keys = np.concatenate([f[1] for f in free]) if free else np.empty(0, np.uint64)
        return values, sizes, keys[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n)

    def word(self, word: str, key: int) -> list[int]:
        """Ids of one occurrence of a unit (spaces already U+2581), by a heap."""
        ids: list[int] = []
        for part in self._heap(word, key):
            i = self.ids.get(part)
            ids.extend((i,) if i is not None else (self.bytes[b] for b in part.encode("utf-8", "surrogatepass")))
        return ids

    def _grow(self, units: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """New nodes for units (places in root_units) under courses; their numbers."""
        words = [self.root_units[u] for u in units.tolist()]
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        first = self.nodes
        for lo in range(0, len(order), 8192):
            part = order[lo : lo + 8192]
            plain = [words[i].replace(" ", _SPACE) if words[i] != _SPACE else _SPACE for i in part.tolist()]
            ids, id_counts, keys, counts = self.courses(plain, masks[part])
            a, b = self.nodes, self.nodes + len(part)
            while b > len(self.counts):
                for name in ("unit_of", "masks", "id_starts", "id_counts", "starts", "counts"):
                    setattr(self, name, np.concatenate((getattr(self, name), np.zeros_like(getattr(self, name)))))
            while self.made_used + len(ids) > len(self.made):
                self.made = np.concatenate((self.made, np.zeros_like(self.made)))
            while self.used + len(keys) > len(self.candidates):
                self.candidates = np.concatenate((self.candidates, np.zeros_like(self.candidates)))
            self.unit_of[a:b], self.masks[a:b], self.id_counts[a:b], self.counts[a:b] = units[part], masks[part], id_counts, counts
            self.id_starts[a:b] = self.made_used + np.cumsum(id_counts) - id_counts
            self.starts[a:b] = self.used + np.cumsum(counts) - counts
            self.made[self.made_used : self.made_used + len(ids)] = ids
            self.candidates[self.used : self.used + len(keys)] = keys
            self.nodes, self.made_used, self.used = b, self.made_used + len(ids), self.used + len(keys)
        out = np.empty(len(units), np.int64)
        out[order] = np.arange(first, first + len(units))
        return out

    def _roots(self, units: list[str]) -> np.ndarray:
        """New roots for units."""
        places = np.arange(len(self.root_units), len(self.root_units) + len(units))
        self.root_units += units
        made = self._grow(places, np.zeros(len(units), np.uint64))
        self.roots.update(zip(units, made.tolist(), strict=True))
        return made

    def _literal(self) -> None:
        """The node of a literal U+2581: its bytes, whatever comes up."""
        node = int(self._roots([_SPACE])[0])
        ids = np.array([self.bytes[b] for b in _SPACE.encode()], np.int32)
        self.id_starts[node], self.id_counts[node], self.counts[node] = self.made_used, len(ids), 0
        while self.made_used + len(ids) > len(self.made):
            self.made = np.concatenate((self.made, np.zeros_like(self.made)))
        self.made[self.made_used : self.made_used + len(ids)] = ids
        self.made_used += len(ids)

    def end_nodes(self, units: list[str], keys: np.ndarray) -> np.ndarray:
        """The node that each occurrence of a unit ends in; -1 for units longer than SCAN."""
        if self.nodes > CACHE:
            self.clear()
        if _SPACE not in self.roots:
            self._literal()
        new = set(units) - self.roots.keys()
        short = [u for u in new if len(u) <= SCAN]
        self._roots(short)
        self.roots.update((u, -1) for u in new if len(u) > SCAN)
        node = np.fromiter(map(self.roots.__getitem__, units), np.int64, len(units))
        if self.limit:
            for lo in range(0, len(units), CHUNK):
                self._follow(node[lo : lo + CHUNK], keys[lo : lo + CHUNK])
        return node

    def _follow(self, node: np.ndarray, keys: np.ndarray) -> None:
        """Move occurrences from their roots to the nodes that they end in."""
        active = np.flatnonzero((node >= 0) & (self.counts[node] > 0))
        while len(active):
            at = node[active]
            counts = self.counts[at]
            ends = np.cumsum(counts)
            owner = np.repeat(np.arange(len(active)), counts)
            turn = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
            hit = _mixed(np.repeat(keys[active], counts) ^ self.candidates[np.repeat(self.starts[at], counts) + turn]) < np.uint64(self.limit)
            who, first = np.unique(owner[hit], return_index=True)
            if not len(who):
                break
            active, at, turn = active[who], at[who], turn[hit][first]
            step, back = np.unique(at << 6 | turn, return_inverse=True)
            place = np.searchsorted(self.turns, step)
            known = np.zeros(len(step), bool)
            inside = place < len(self.turns)
            known[inside] = self.turns[place[inside]] == step[inside]
            to = np.empty(len(step), np.int64)
            to[known] = self.turned[place[known]]
            new = np.flatnonzero(~known)
            if len(new):
                parents = step[new] >> 6
                masks = self.masks[parents]
                # the candidates of a node are counted from its last skip on
                base = np.where(masks > 0, np.frexp(masks.astype(np.float64))[1], 0).astype(np.uint64)
                to[new] = self._grow(self.unit_of[parents], masks | (np.uint64(1) << (base + (step[new] & 63).astype(np.uint64))))
                self.turns, self.turned = np.insert(self.turns, place[new], step[new]), np.insert(self.turned, place[new], to[new])
            node[active] = to[back]
            active = active[self.counts[node[active]] > 0]

    def encode_all(self, texts: list[str | None], documents: list[int]) -> list[np.ndarray | None]:
        """Ids of many texts (None for None); documents: a number for each, part of the key of its units.

        The empty text has no ids. A literal U+2581 is written as bytes, so that it is not read
        back as a space.
        """
        cut = [(_PLAIN if self.mixed and self.mixed.search(t) else self.units).findall(" " + t) if t else [] for t in texts]
        keys = np.concatenate([np.empty(0, np.uint64), *[self.occurrence_keys(d, len(c)) for c, d in zip(cut, documents, strict=True)]])
        units = [u for c in cut for u in c]
        nodes = self.end_nodes(units, keys)
        long = {i: self.word(units[i].replace(" ", _SPACE), int(keys[i])) for i in np.flatnonzero(nodes < 0).tolist()}
        counts = np.where(nodes >= 0, self.id_counts[nodes], 0).astype(np.int64)
        starts = np.where(nodes >= 0, self.id_starts[nodes], 0)
        for i, ids in long.items():
            counts[i] = len(ids)
        ends = np.cumsum(counts)
        ids = self.made[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)] if not long else np.empty(ends[-1], np.int32)
        if long:
            short = np.repeat(nodes >= 0, counts)
            ids[short] = self.made[(np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1]))[short]]
            for i, x in long.items():
                ids[ends[i] - len(x) : ends[i]] = x
        out, at, done = [], 0, 0
        for t, c in zip(texts, cut, strict=True):
            at += len(c)
            end = int(ends[at - 1]) if at else 0
            out.append(None if t is None else ids[done:end])
            done = end
        return out

    def encode(self, text: str, document: int = 0) -> np.ndarray:
        """Ids of a text."""
        return self.encode_all([text], [document])[0]

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")[1:]


#: Encoders of this worker by model and options, so that tasks share what is cached.
_ENCODERS: dict[tuple, MergeEncoder] = {}


def shared_encoder(model, dropout: float, seed: int) -> MergeEncoder:
    """The worker's encoder for a broadcast model."""
    key = (model.id if hasattr(model, "id") else id(model), len(model.value), dropout, seed)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = MergeEncoder(model.value, dropout, seed)
    return _ENCODERS[key]


def with_tokens(docs: DataFrame, pieces: list[tuple[str, int, float]] | None = None, text_col: str = "text", key_col: str = "doc_id", dropout: float = DROPOUT, seed: int = SEED, into: str = "__tokens") -> DataFrame:
    """docs with a struct column into (in place of one of that name): token_ids array<int> and lossless (decoding gives the text back).

    Every occurrence of a unit in a document is segmented by its own key, made of the seed, the
    document's key and the unit's place; dropout 0 gives the model's own segmentation. A null
    text has null token_ids and a null lossless; the empty text has no ids and is lossless.
    Texts of any length are encoded whole. Rows are independent: null keys are one key, and
    rows that repeat key and text repeat their ids. Other columns pass through.
    """
    bound_batches(docs)
    model = docs.sparkSession.sparkContext.broadcast(pieces or load_pieces())
    kind = pa.struct([("token_ids", pa.list_(pa.int32())), ("lossless", pa.bool_())])

    @F.arrow_udf("struct<token_ids:array<int>,lossless:boolean>")
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        enc = shared_encoder(model, dropout, seed)
        for texts, keys in batches:
            ids, same = [], []
            for lo in range(0, len(texts), 256):
                part = texts.slice(lo, 256).to_pylist()
                got = enc.encode_all(part, keys.slice(lo, 256).to_pylist())
                same += [None if x is None else enc.decode(x) == t for t, x in zip(part, got, strict=True)]
                ids += [np.empty(0, np.int32) if x is None else x for x in got]
            offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)), mask=pa.array([s is None for s in same]))
            yield pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], fields=list(kind))

    return docs.withColumn(into, encode(F.col(text_col), F.xxhash64(F.col(key_col))))


def encode_documents(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_tokens, token_ids, lossless (see with_tokens)."""
    out = with_tokens(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", F.size("__tokens.token_ids").cast("long").alias("n_tokens"), "__tokens.token_ids", "__tokens.lossless")
