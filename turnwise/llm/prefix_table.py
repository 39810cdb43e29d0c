"""Operator 12: SentencePiece (merge-type) encoding by a table of last pieces, and decoding.

A merge-type model glues the adjacent pair of best score until no pair is a piece.  Two facts make
one pass enough.  A run of pieces is the encoding of its text exactly if every two neighbours are
the encoding of theirs (``compatible``); and so every prefix of a text has one last piece.
``PrefixTable`` walks over the pieces that an Aho-Corasick automaton finds, by their ends, and
stores for each prefix the piece that is compatible with the last piece of the prefix before it.
The ids are read off backwards.  Time is linear in a text's length, with no merge queue.

No piece of the model reaches from a visible character to a following space, so a text is cut
there.  The words a worker has not seen yet are worked out together, all prefixes of one length
in one step; long words on their own.  Models with other pieces, or that normalise texts, are
refused when they are loaded; pairs for which merges are not in the order of the scores are
tested by merging.

Scale: one pass, no shuffle; a worker remembers a bounded number of words and pairs, which
changes the speed only.  Long texts are encoded in time linear in their length.

Defined results: null text is empty (no ids, empty decoded text); null or repeated ids each keep
their row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"  # how the model writes a space; fixed by the model format
NEVER = 1 << 60
START, UNKNOWN, NONE = -1, -2, -3  # what stands before a prefix's last piece, besides pieces
_SPACED = re.compile(f"{SPACE}+[^{SPACE}]*")
IDS_SCHEMA = "ids array<int>, decoded string"


class PrefixTable:
    """Encoder of one model.  ``encode(texts)`` gives the ids that the library gives."""

    def __init__(self, path: str, words: int = 300_000, pair_bits: int = 21):
        import sentencepiece
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.vocab_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in ids}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # A merge happens in the order of the scores; equal scores are one step, leftmost pair first.
        step = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in ids}, reverse=True))}
        self.step = {self.piece[i]: step[sp.get_score(i)] for i in ids}
        self.known = {p for p in self.step if len(p) == 1}
        self.codes = np.array(sorted(map(ord, self.known)), np.uint32)
        if not all(c in self.known for p in self.step for c in p) or any(SPACE in p.lstrip(SPACE) for p in self.step):
            raise ValueError("the model has pieces that reach over the cuts of this encoder")
        if sp.encode("a  a", out_type=str)[:2] != [SPACE + "a", SPACE] or any(sp.normalize(x) != SPACE + x for x in ("ﬁ", "½", "é", "A")):
            raise ValueError("the model changes texts before it encodes them")
        self.left, self.right, self.by_hand = {}, {}, set()
        shared = {s for s, n in zip(*np.unique(list(self.step.values()), return_counts=True)) if n > 1}
        made = []
        for i in ids:
            p = self.piece[i]
            split = self._last_merge(p)
            if split is None:
                continue  # the merges never end in this piece
            if self.step[p] in shared or any(len(h) > 1 and self.step[h] >= self.step[p] for h in split):
                self.by_hand.add(i)
            made.append(i)
        self._automaton(made)
        self.size = np.ones(sp.vocab_size(), np.int64)
        self.size[ids] = [len(self.piece[i]) for i in ids]
        # Pairs already tested, by a hash of the pair; a later pair may take an earlier one's place.
        self.pair_bits = pair_bits
        self.pair = np.full(1 << pair_bits, -1, np.int64)
        self.fits = np.zeros(1 << pair_bits, bool)
        self.memo, self.limit = {}, words

    def _automaton(self, ids: list[int]) -> None:
        """States for the beginnings of pieces: edges, where to go on without one, pieces that end."""
        edge: dict = {}
        own = {}
        for i in ids:
            state = 0
            for c in self.piece[i]:
                state = edge.setdefault((state, c), len(edge) + 1)
            own[state] = i
        ends = [()] * (len(edge) + 1)
        back = [0] * (len(edge) + 1)
        children: dict = {}
        for (a, c), b in edge.items():
            children.setdefault(a, []).append((c, b))
        queue = [0]
        for a in queue:
            for c, b in children.get(a, ()):
                if a:
                    f = back[a]
                    while f and (f, c) not in edge:
                        f = back[f]
                    back[b] = edge.get((f, c), 0)
                ends[b] = ((own[b],) if b in own else ()) + ends[back[b]]
                queue.append(b)
        self.edge, self.back, self.ends = edge, back, ends
        kind = {chr(c): k for k, c in enumerate(self.codes.tolist())}
        key = np.array([a * len(kind) + kind[c] for a, c in edge], np.int64)
        order = np.argsort(key)
        self.edge_key, self.edge_to = key[order], np.array(list(edge.values()), np.int64)[order]
        self.backs = np.array(back, np.int64)
        self.n_ends = np.array([len(e) for e in ends], np.int64)
        self.first_end = np.cumsum(self.n_ends) - self.n_ends
        self.all_ends = np.array(list(chain.from_iterable(ends)), np.int64)

    def merged(self, text: str) -> list[str]:
        """The merges done one by one (short strings only)."""
        parts = list(text)
        while True:
            best = min(((self.step.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(NEVER, 0))
            if best[0] == NEVER:
                return parts
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def _last_merge(self, piece: str) -> tuple | None:
        """The two parts that the last merge of a piece glues (``()`` for one character)."""
        if len(piece) == 1:
            return ()
        parts = list(piece)
        while len(parts) > 2:
            s, k = min((self.step.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if s == NEVER:
                return None
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return tuple(parts)

    def _edge(self, piece: str, side: int) -> list[tuple[str, int, int]]:
        """The parts that stand at one edge of ``piece`` while it is made: ``(part, made, used up)``."""
        known = (self.left, self.right)[side]
        if piece not in known:
            out, end, p = [], NEVER, piece
            while len(p) > 1:
                made = self.step[p]
                out.append((p, made, end))
                end, p = made, self._last_merge(p)[side]
            known[piece] = [*out, (p, -1, end)]
        return known[piece]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` and ``b`` is encoded as these two pieces.

        It is not if some part at the end of ``a`` and some part at the start of ``b`` stand side by
        side before either is used up, and their merge comes first (of equal ones: the left one).
        """
        x, y = self.piece[a], self.piece[b]
        if a in self.by_hand or b in self.by_hand:
            return self.merged(x + y) == [x, y]
        step = self.step
        for p, made_p, end_p in self._edge(x, 1):
            for q, made_q, end_q in self._edge(y, 0):
                if made_p < end_q and made_q < end_p:
                    s = step.get(p + q)
                    if s is not None and s < end_p and s <= end_q:
                        return False
        return True

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` for arrays of ids; anything fits the start and unknown characters."""
        ok = a < 0
        at = np.flatnonzero(~ok)
        key = a[at] << 32 | b[at]
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.pair_bits)).astype(np.int64)
        known = self.pair[slot] == key
        if not known.all():
            new, back = np.unique(key[~known], return_inverse=True)
            tests = np.array([self.compatible(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], bool)
            res = self.fits[slot]
            res[~known] = tests[back]
            self.pair[slot[~known]], self.fits[slot[~known]] = key[~known], res[~known]
            # Of pairs that share a slot only one may stay, with its own result.
            lost = self.pair[slot] != key
            ok[at] = res
            if lost.any():
                self.pair[slot[lost]] = -1
        else:
            ok[at] = self.fits[slot]
        return ok

    def _advance(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The automaton's states after one more character each (unknown characters: the start)."""
        state, to = state.copy(), np.zeros(len(state), np.int64)
        todo = np.flatnonzero(kind >= 0)
        while len(todo):
            key = state[todo] * len(self.codes) + kind[todo]
            k = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            hit = self.edge_key[k] == key
            to[todo[hit]] = self.edge_to[k[hit]]
            todo = todo[~hit]
            todo = todo[state[todo] > 0]
            state[todo] = self.backs[state[todo]]
        return to

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian uint32) of words of moderate length, all at once."""
        words_at = sorted(range(len(words)), key=lambda k: -len(words[k]))
        text = "".join(words[k] for k in words_at)
        sizes = np.array([len(words[k]) for k in words_at], np.int64)
        starts = np.cumsum(sizes) - sizes
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        kinds[self.codes[kinds] != codes] = -1
        base = starts + np.arange(len(words))  # a word has one place more than characters
        last = np.full(len(text) + len(words), NONE, np.int64)
        last[base] = START
        state = np.zeros(len(words), np.int64)
        for depth in range(1, int(sizes.max(initial=0)) + 1):
            # One step for all words: their prefixes of this length.
            n = np.searchsorted(-sizes, -depth, "right")
            kind, at = kinds[starts[:n] + depth - 1], base[:n] + depth
            state = self._advance(state[:n], kind)
            last[at[kind < 0]] = UNKNOWN
            times = self.n_ends[state]
            who = np.repeat(np.arange(n), times)
            piece = self.all_ends[np.arange(len(who)) - np.repeat(np.cumsum(times) - times - self.first_end[state], times)]
            before = last[at[who] - self.size[piece]]
            ok = (before != NONE) & self._fit(before, piece)
            last[at[who[ok]]] = piece[ok]
        # Read backwards: the pieces of a word, last first.
        who, steps, at = np.flatnonzero(sizes > 0), [(np.zeros(0, np.int64),) * 3], (base + sizes)[sizes > 0]
        while len(who):
            piece = last[at]
            at = at - np.where(piece < 0, 1, self.size[piece])
            steps.append((who, piece, at))
            more = at > base[who]
            who, at = who[more], at[more]
        who, piece, at = (np.concatenate(c) for c in zip(*steps))
        order = np.argsort(at)
        who, piece, at = who[order], piece[order], at[order]
        unknown = np.flatnonzero(piece == UNKNOWN)
        as_bytes = [[self.bytes[b] for b in text[i].encode("utf-8")] for i in (at - who)[unknown].tolist()]
        times = np.ones(len(piece), np.int64)
        times[unknown] = [len(x) for x in as_bytes]
        ids = np.repeat(piece, times)
        ids[ids == UNKNOWN] = list(chain.from_iterable(as_bytes))
        cuts = np.cumsum(np.bincount(who, times, len(words)).astype(np.int64)) * 4
        raw, out = ids.astype("<u4").tobytes(), [b""] * len(words)
        for k, i, j in zip(words_at, [0, *cuts.tolist()], cuts.tolist()):
            out[k] = raw[i:j]
        return out

    def _long(self, word: str) -> bytes:
        """Ids of one long word, position by position."""
        last, fits, state = [UNKNOWN] * (len(word) + 1), {}, 0
        for end, c in enumerate(word, 1):
            while state and (state, c) not in self.edge:
                state = self.back[state]
            state = self.edge.get((state, c), 0)
            for t in self.ends[state]:
                n = len(self.piece[t])
                a = last[end - n] if n < end else START
                if a >= 0:
                    if (a, t) not in fits:
                        fits[a, t] = self.compatible(a, t)
                    if not fits[a, t]:
                        continue
                last[end] = t
                break
        out, at = [], len(word)
        while at:
            t = last[at]
            out += [t] if t >= 0 else [self.bytes[b] for b in reversed(word[at - 1].encode("utf-8"))]
            at -= len(self.piece[t]) if t >= 0 else 1
        return np.array(out[::-1], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian uint32 bytes."""
        split = []
        for t in texts:
            if "  " in t or SPACE in t or t[:1] == " " or t[-1:] == " ":
                split.append(_SPACED.findall(SPACE + t.replace(" ", SPACE)))
            else:
                split.append(t.split(" ") if t else [])
        known = self.memo.get
        found = [list(map(known, words)) for words in split]
        missing = list({w for words, ids in zip(split, found) if None in ids for w, x in zip(words, ids) if x is None})
        if missing:
            full = [w if w[0] == SPACE else SPACE + w for w in missing]
            short = [k for k, w in enumerate(full) if len(w) <= 64]
            new = dict(zip([missing[k] for k in short], self._learn([full[k] for k in short])))
            if len(self.memo) < self.limit:
                self.memo.update(new)
            new.update((missing[k], self._long(w)) for k, w in enumerate(full) if len(w) > 64)
            found = [[new[w] if x is None else x for w, x in zip(words, ids)] if None in ids else ids for words, ids in zip(split, found)]
        return [b"".join(ids) for ids in found]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


_tables: dict[str, PrefixTable] = {}


def table(path: str) -> PrefixTable:
    """This worker's encoder for the model at ``path``."""
    if path not in _tables:
        _tables[path] = PrefixTable(path)
    return _tables[path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", texts_at_once: int = 300) -> DataFrame:
    """``id, ids array<int>, decoded string`` of every row: the ids of its text and what they decode to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(model_path)
        for b in batches:
            for i in range(0, b.num_rows, texts_at_once):  # few texts at a time are Python objects
                part = b.slice(i, texts_at_once)
                texts = part.column("text").to_pylist()
                raw = [x for a, c in slices(texts) for x in t.encode(texts[a:c])]
                at = np.cumsum([0] + [len(x) // 4 for x in raw]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                decoded = pa.array([t.decode(np.frombuffer(x, "<u4").tolist()) for x in raw], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, decoded], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {IDS_SCHEMA}").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of the result of ``encode_decode``."""
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
