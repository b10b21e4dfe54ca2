"""Token ids of whole texts by a public tokenizer, as little-endian 32-bit bytes.

A text is cut before single spaces that a plain character follows.  For both
tokenizers in use such a cut never lies inside a token and never changes its
neighbours, so each part's ids can be found by themselves and remembered; the
concatenation equals the library's ids of the whole text.  A text with any
other kind of space sequence goes to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import pairwise

import numpy as np

END_ID = np.array([1], "<u4").tobytes()
#: Parts remembered by one Python worker, and the longest part remembered.
KEPT_PARTS, KEPT_LENGTH = 700_000, 40
#: Parts of characters that are neither white space nor combining, nor become so in lower case (U+0130); short enough to remember.
#: Begins a part that follows a line feed, not a space.
LINE = "\x00"
MARKS = ".,;:!?*#%&$"
PRINTED = re.compile(r"[!-{}-~\u00a1-\u012f\u0131-\u024f]{1,40}").fullmatch


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text) -> bytes.  lead: the space before a part belongs to it (byte-level BPE)."""

    def __init__(self, path: str, lead: bool, kept: int = KEPT_PARTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept = kept
        self.lead = " " if lead else ""
        #: The tokenizer lower-cases letter by letter, as str.lower does but for two letters.
        self.lower = not lead and self.library(["AbC\u00c9"]) == self.library(["abc\u00e9"])
        #: Ids of a part as it stands after a space.
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        #: Stands between parts that are encoded together: one id, never joined to its neighbours.
        self.mark = "\n" if lead else " | "
        mark = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = mark[0] if len(mark) == 1 else None

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, parts: list[str]) -> list[bytes]:
        """Ids of parts without white space or mark, 4,096 in one call."""
        out: list[bytes] = []
        for a in range(0, len(parts), 4096):
            some = parts[a : a + 4096]
            joined = self.lead + (self.mark + self.lead).join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark_id)
            if self.mark_id is None or len(ends) != len(some) - 1:
                out += self.library([self.lead + p for p in some])
                continue
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            out += [raw[x:y] for x, y in zip([0, *[e + 4 for e in ends]], [*ends, len(raw)], strict=True)]
        return out

    @staticmethod
    def plain(part: str) -> bool:
        """Starts with a character that no tokenizer takes for white space."""
        c = ord(part[0])
        return 0x21 <= c <= 0x7E or 0xA1 <= c <= 0x24F

    def learn(self, wanted: set[str], of: int) -> dict[str, bytes]:
        """Ids of parts not known yet, ``of`` parts read; what is not found here has no plain start or is long."""
        if len(self.known) >= self.kept and 6 * len(wanted) > of:  # the texts have changed
            self.known.clear()
        known, ask, stemmed, rest = self.known, set(), [], []
        for p in wanted:
            if p and (len(p) <= KEPT_LENGTH and "|" not in p and " " not in p if p.isascii() and p.isprintable() else PRINTED(p)):
                if p[-1] in MARKS:
                    stem = p.rstrip(MARKS)
                    if stem.isalpha():  # letters and the marks after them are always encoded apart
                        stemmed.append((p, stem))
                        if stem not in known:
                            ask.add(stem)
                        continue
                ask.add(p)
            elif p and len(p) <= KEPT_LENGTH and self.plain(p):
                rest.append((p, self.lead + p))
            elif self.lead and p[:1] == LINE and PRINTED(p[1:]):
                rest.append((p, "\n" + p[1:]))
        found = known if len(known) < self.kept else {}
        single = list(ask)
        found.update(zip(single, self.together(single), strict=True))
        if rest:
            found.update(zip([p for p, _ in rest], self.library([text for _, text in rest]), strict=True))
        if stemmed:
            new = list({p[len(stem) :] for p, stem in stemmed}.difference(self.tails))
            self.tails.update(zip(new, self.library(new), strict=True))
            tails = self.tails
            for p, stem in stemmed:
                ids = found.get(stem)
                found[p] = (known[stem] if ids is None else ids) + tails[p[len(stem) :]]
            if len(tails) > 10_000:
                tails.clear()
        if not self.lead:
            found[""] = b""
        return found

    def lines(self, text: str) -> str:
        """Single line feeds between plain characters as a space and a mark: such a line feed is always a token of its own."""
        if "\n" not in text or LINE in text:
            return text
        cut = text.split("\n")
        out = [cut[0]]
        for a, b in pairwise(cut):
            out += [" " + LINE if a and b and self.plain(a[-1]) and self.plain(b) else "\n", b]
        return "".join(out)

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if self.lower:  # white space is dropped, whatever it is
            texts = [(t if "\u03a3" in t or "\u0130" in t else t.lower()).replace("\n", " ") for t in texts]
        if self.lead:
            odd = [k for k, t in enumerate(texts) if LINE in t]
            if odd:
                out, whole = self.batch([t for t in texts if LINE not in t]), dict(zip(odd, self.library([texts[k] for k in odd]), strict=True))
                rest = iter(out)
                return [whole[k] if k in whole else next(rest) for k in range(len(texts))]
            texts = list(map(self.lines, texts))
        get = self.known.get
        cut = [t.split(" ") for t in texts]
        heads = [c.pop(0) for c in cut] if self.lead else [""] * len(cut)
        values = [list(map(get, parts)) for parts in cut]
        gaps: list[list[int]] = []
        wanted: set[str] = set()
        for parts, vs in zip(cut, values, strict=True):
            gap, i = [], -1
            for _ in range(vs.count(None)):
                i = vs.index(None, i + 1)
                gap.append(i)
                wanted.add(parts[i])
            gaps.append(gap)
        found = self.learn(wanted, sum(map(len, cut))).get if wanted else None
        first = self.library(heads) if self.lead else [b""] * len(cut)
        out: list[bytes] = []
        for head, start, parts, vs, gap in zip(heads, first, cut, values, gaps, strict=True):
            whole = True
            for i in gap:
                ids = found(parts[i])
                if ids is None:
                    whole = False
                vs[i] = ids
            out.append(start + b"".join(vs) if whole else self.slowly(head, parts, vs))
        return out

    def slowly(self, head: str, parts: list[str], values: list[bytes | None]) -> bytes:
        """Known parts are taken; what lies between goes to the library in one piece."""
        runs: list[list] = [[head, None]]
        for p, v in zip(parts, values, strict=True):
            if p[:1] == LINE and self.lead:
                runs.append(["\n" + p[1:], v])
            elif p and self.plain(p):
                runs.append([" " + p, v])
            else:
                runs[-1] = [runs[-1][0] + " " + p, None]
        found = iter(self.library([text if self.lead else text.lstrip(" ") for text, v in runs if v is None]))
        return b"".join(next(found) if v is None else v for _, v in runs)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, lead: bool, kept: int = KEPT_PARTS) -> Encoder:
    """One for each Python worker; it remembers ``kept`` parts from now on."""
    if (path, lead) not in _ENCODERS:
        _ENCODERS[path, lead] = Encoder(path, lead, kept)
    enc = _ENCODERS[path, lead]
    if kept < enc.kept:  # another query's tasks came before
        enc.known.clear()
    enc.kept = kept
    return enc


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()
