"""Exact ids of whole texts by the tokenizers library, remembered per space-delimited piece.

Neither tokenizer family used here builds a token across the border between a visible character
and a following space: byte-level BPE attaches the space to what follows, word-end BPE drops it.
So a text's ids are the ids of its pieces in order, and the library has to encode each distinct
piece once.  Texts for which the split would not be exact (white space before a space, the
string of a special token) are encoded whole by the library.
"""

from __future__ import annotations

import os
import re
from itertools import filterfalse, islice
from operator import methodcaller

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices

_SPACE_BEFORE_SPACE = re.compile(r" (?<=\s )")
# A line's last piece and the next line's first: a lone line end between visible characters.
_LINE_END = re.compile("[^\n]*[!-~\u00c0-\u024f]\n[!-~\u00c0-\u024f][^\n]*")
_TAIL = ".,!?;:%$&*#|"
_stripped = methodcaller("rstrip", _TAIL)


class PieceEncoder:
    """``encode(texts)`` gives each text's ids as little-endian uint32 bytes.

    ``limit`` bounds the remembered pieces per worker (about 200 bytes each); it changes the
    speed only.  A piece that ends in a letter and a run of plain punctuation is the two parts'
    ids put together, since both tokenizers always split there; so does the byte-level one on both
    sides of a lone line end.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # Byte-level vocabularies write a leading space as this letter; word-end ones drop it.
        self.lead = " " if self.tok.get_vocab_size() and self.tok.token_to_id("Ġthe") is not None else ""
        self.limit, self.memo, self.tails, self.heads = limit, {}, {}, {}
        if self.lead:
            vocab = self.tok.get_vocab()
            self.opens = np.zeros(max(vocab.values()) + 1, bool)
            self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _bases(self, words: list[str]) -> list[bytes]:
        """Ids of pieces, each as it stands after a space."""
        if not self.lead:
            return self._library(words)
        out: list[bytes] = []
        for i in range(0, len(words), 2000):
            part = words[i:i + 2000]
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(part) or not len(at) or at[0]:
                out += self._library([" " + w for w in part])
            else:
                raw, ends = ids.tobytes(), [*(at[1:] * 4).tolist(), len(ids) * 4]
                out += [raw[a:b] for a, b in zip((at * 4).tolist(), ends)]
        return out

    def _learn(self, missing: list[str]) -> list[bytes]:
        """Ids of the distinct pieces of a batch that are not remembered."""
        ends = {p: p.index("\n") for p in missing if "\n" in p and _LINE_END.fullmatch(p)} if self.lead else {}
        lasts = {p[:k] for p, k in ends.items()}
        got = self._learn_words(list({*filterfalse(ends.__contains__, missing), *filterfalse(self.memo.__contains__, lasts)}))
        heads = {p[k:] for p, k in ends.items()}
        new_heads = list(heads.difference(self.heads))
        if new_heads:
            if len(self.heads) > 100_000:
                self.heads.clear()
                new_heads = list(heads)
            self.heads.update(zip(new_heads, self._library(new_heads)))
        known = self.memo
        for p, k in ends.items():
            last = p[:k]
            ends[p] = (got[last] if last in got else known[last]) + self.heads[p[k:]]
        return [ends[p] if p in ends else got[p] for p in missing]

    def _learn_words(self, missing: list[str]) -> dict[str, bytes]:
        """Encode pieces of one line that are not remembered; the result knows them all."""
        tailed = {p: s for p, s in zip(missing, map(_stripped, missing)) if s is not p and s and s[-1].isalpha()}
        whole = list(filterfalse(tailed.__contains__, missing)) if tailed else missing
        tails = {p: p[len(s):] for p, s in tailed.items()}
        new_tails = list(set(tails.values()).difference(self.tails))
        if new_tails:
            if len(self.tails) > 100_000:
                self.tails.clear()
                new_tails = list(set(tails.values()))
            self.tails.update(zip(new_tails, self._library(new_tails)))
        need = list({*whole, *filterfalse(self.memo.__contains__, tailed.values())})
        got = dict(zip(need, self._bases(need)))
        keep = len(self.memo) < self.limit
        if keep:
            self.memo.update(got)
            got = self.memo
        known = self.memo
        put = {p: (got[s] if s in got else known[s]) + self.tails[tails[p]] for p, s in tailed.items()}
        if keep and len(known) < self.limit // 2:
            known.update(put)
            return known
        return {**{p: got[p] for p in whole}, **put}

    def rest(self, keep: int = 300_000) -> None:
        """Forget all but the first pieces learned (the frequent ones) when a task ends, so that
        idle workers stay small."""
        if len(self.memo) > keep:
            self.memo = dict(islice(self.memo.items(), keep))
        if len(self.heads) > keep:
            self.heads = {}

    def _pieces(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts of space-delimited pieces (null: none), each distinct piece looked up once."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words = lists.flatten().dictionary_encode()
        # No piece holds a space, so one string carries them all (a list of strings is slow to make).
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py()
        distinct = distinct.split(" ") if len(words) else []
        known = list(map(self.memo.get, distinct))
        gaps = [j for j, ids in enumerate(known) if ids is None]
        for j, ids in zip(gaps, self._learn([distinct[j] for j in gaps])):
            known[j] = ids
        # Every word's ids are copied from where the distinct pieces' ids lie one after the other.
        ids = np.frombuffer(b"".join(known), np.uint32)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = np.cumsum(size) - size
        word = words.indices.to_numpy()
        n = size[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = ids[np.repeat(at[word] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        per_text = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        bounds = (ends[np.concatenate([[0], np.cumsum(per_text)])] * 4).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for a, b in slices(texts, 8_000_000):
            part = texts[a:b]
            whole = [i for i, t in enumerate(part) if _SPACE_BEFORE_SPACE.search(t) or any(s in t for s in self.specials)]
            res: list = [None] * len(part)
            if whole:
                for i, ids in zip(whole, self._library([part[i] for i in whole])):
                    res[i] = ids
            todo = [i for i in range(len(part)) if res[i] is None]
            plain = [part[i] for i in todo]
            firsts = [b""] * len(plain)
            if self.lead:
                cut = [t.partition(" ") for t in plain]
                firsts = self._library([c[0] for c in cut])
                plain = [c[2] if c[1] else None for c in cut]
            for k, (i, ids) in enumerate(zip(todo, self._pieces(plain))):
                res[i] = firsts[k] + ids
            out += res
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for the vocabulary file at ``path``."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
