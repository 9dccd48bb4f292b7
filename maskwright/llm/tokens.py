"""Byte-level BPE token ids by the ``tokenizers`` library, in 16-bit arrays.

Encoding is exact: a text is cut only where the byte-level pre-tokeniser cuts
it anyway (before a space that a non-space follows), each distinct piece is
encoded once by the library and its ids kept in a bounded per-process cache.
Texts with runs of white space around a space, or with a special token's
string, go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np

from .common import keeps

#: Pieces kept per Python process (about 200 bytes each).
CACHE_PIECES = 1_000_000
#: Longer pieces are encoded but not kept.
CACHE_CHARS = 48
#: Pieces encoded in one library call string.
GROUP = 100

_EDGE = re.compile(r"\s\Z")
#: Marks that the pre-tokeniser keeps together and apart from letters.
_MARKS = ".,;:!?*#$%&|()"


class Encoder:
    """``encode(texts)`` gives for each text the little-endian unsigned 16-bit ids as bytes.

    A special token's string in a text gets that token's id, as the library has it by default. None counts as empty.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([r" (?:\s|\Z)", *special]))
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        mark = self.tokenizer.encode("\r", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.inner: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. Pieces are joined by a mark that no piece holds and
        that the pre-tokeniser always cuts off, as every following piece starts
        with a space and none ends with white space."""
        if self.mark is None:
            return self._whole(pieces)
        out: list[bytes] = [b""] * len(pieces)
        odd = [i for i, p in enumerate(pieces) if not p.startswith(" ") or "\r" in p or _EDGE.search(p)]
        for i, ids in zip(odd, self._whole([pieces[i] for i in odd]), strict=True):
            out[i] = ids
        strange = set(odd)
        plain = [i for i in range(len(pieces)) if i not in strange]
        groups = [plain[k : k + GROUP] for k in range(0, len(plain), GROUP)]
        texts = ["\r".join([pieces[i] for i in g]) for g in groups]
        for g, enc in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(enc.ids, dtype="<u2")
            raw, at = ids.tobytes(), 0
            ends = (2 * np.flatnonzero(ids == self.mark)).tolist()
            for i, end in zip(g, [*ends, len(raw)], strict=True):
                out[i] = raw[at:end]
                at = end + 2
        return out

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        inner, first = self.inner, self.first
        if len(inner) + len(first) > CACHE_PIECES:
            inner.clear()
            first.clear()
        whole, cut, words = [], [], []
        for i, t in enumerate(texts):
            if t:
                if self.whole.search(t):
                    whole.append(i)
                else:
                    head, *rest = t.split(" ")
                    cut.append((i, head, len(words), len(words) + len(rest)))
                    words += rest
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        got = list(map(inner.get, words))
        missing, at = [], -1
        try:
            while True:
                at = got.index(None, at + 1)
                missing.append(at)
        except ValueError:
            pass
        new = {words[at] for at in missing}
        heads = {head for _, head, _, _ in cut if head not in first}
        self._learn(new, heads)
        for at in missing:
            got[at] = inner[words[at]]
        for i, head, a, b in cut:
            out[i] = first[head] + b"".join(got[a:b])
        for kept, names in ((inner, new), (first, heads)):
            for w in names:
                if len(w) > CACHE_CHARS:
                    del kept[w]
        return out

    def _learn(self, new: set[str], heads: set[str]) -> None:
        """Put pieces in the caches. A piece of letters with marks behind is cut
        between the two, where the pre-tokeniser cuts it too."""
        inner, first = self.inner, self.first
        joined = []
        plain, starts = set(), set(heads)
        for w in new:
            core = w.rstrip(_MARKS)
            if len(core) < len(w) and core.isalpha():
                joined.append((w, core, w[len(core) :]))
                if core not in inner:
                    plain.add(core)
                if w[len(core) :] not in first:
                    starts.add(w[len(core) :])
            else:
                plain.add(w)
        plain_, starts_ = list(plain), list(starts)
        made = self._pieces([" " + w for w in plain_] + starts_)
        inner.update(zip(plain_, made, strict=False))
        first.update(zip(starts_, made[len(plain_) :], strict=True))
        for w, core, marks in joined:
            inner[w] = inner[core] + first[marks]


_encoders: dict[str, Encoder] = {}
keeps("tokens", _encoders.clear)


def encoder(path: str) -> Encoder:
    """One encoder per process and file, so that its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
