"""Sentence units of documents in many languages and scripts, by document-centred disambiguation.

Whether a period ends a sentence is decided by unambiguous occurrences elsewhere, not by lists of words:

* a word whose period is followed by a small letter, digit or comma is an abbreviation there; one whose
  period ends a paragraph is not;
* a capitalised word that stands in small letters elsewhere, or begins paragraphs, is a common word; one
  that is capitalised after a small letter or comma is a name;
* an abbreviation may end a sentence if words that begin paragraphs follow it.

Two occurrences in the document that agree decide; otherwise the whole corpus's counts do (an abbreviation
shows there by unambiguous occurrences, or by hardly ever ending a paragraph and never standing without its
period); then a single occurrence in the document, and last the word's form (initials, inner periods).
Terminators of scripts, quotations, numbers and Thai, which has no full stop, follow rules of their own.

The first pass counts the evidence, per word and exactly, the second splits the documents. The corpus's
verdicts travel to the tasks as sorted 64-bit hashes if there are at most LEXICON_WORDS of them; beyond that
they are joined to the documents that ask for them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

FLUSH = 300_000  # counters that a task holds before it hands them on
TOKENS, TOKEN_LETTERS = 1 << 16, 40  # what is remembered of tokens in a process: so many, of so many letters at most
SHORT = 10_000  # letters of a text that is searched for a word rather than taken apart
LEXICON_WORDS = 1 << 22  # verdicts that are shipped to every task (9 bytes each); more are joined
SURE, LETTER = 0.7, 5.0  # a word of n letters is an abbreviation if it ends fewer paragraphs than usual by a log-likelihood of SURE * LETTER**n

# Brackets and quotation marks by role.
OPENERS = "([{«„“‚‘「『（【《〈\"'¿¡"
CLOSERS = ")]}»”’」』）】》〉\"'“"
PARTNERS = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“„", "“": "„", "’": "‘‚", "」": "「", "』": "『", "）": "（", "】": "【", "》": "《", "〉": "〈"}
# Question particles that end a Thai sentence.
THAI_FINAL = ("หรือไม่", "ไหม", "หรือเปล่า", "ครับ", "ค่ะ")

_GAP = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+|\r\n[^\S\n]*(?:\r\n[^\S\n]*)+")
_MARKS = "!?。！？।؟…"
_INSIDE = r"(?![^\W\d_A-ZÀ-ÖØ-ÞЀ-Я؀-ۿऀ-ॿ一-鿿぀-ヿ]|[\d,;:\-−–/_^])"
_TERM = re.compile(rf"[.{_MARKS}](?:(?<!\.)|(?=\.)|{_INSIDE})[.{_MARKS}]*")
_STOP = re.compile(rf"\.(?:(?=\.)|{_INSIDE})\.*")  # _TERM where periods are the only marks: searched for a letter, not a class
_CLOSED = re.compile(r"\.(?:[,;:](?!\S)|(?!\S|\s+[A-ZÀ-ÖØ-ÞЀ-Я]))")  # a period at the end of a token, most capitals behind it left out
_NUMBER = re.compile(r"\s*(?:[\[［【(（][^\]］】)）\n]{0,12}\d+[^\]］】)）\n]{0,6}[\]］】)）]|\d+\s*(?:[.)．、](?!\d)|(?=\s*$)))\s*")
_BEFORE_WORD = frozenset("([«„“\"”»（「『】]" + "".join(chr(c) for c in range(0x3001) if chr(c).isspace()))
_WORD = re.compile(r"[^\W\d_]+")
_INITIAL = re.compile(r"(\w)\.\s*\w$")
_EDGES = "()[]{}«»„“”‘’\"'（）「」『』【】《》〈〉¿¡.,;:!?…"
_MID = re.compile(r" ([A-ZÀ-ÞЀ-Я](?<=[a-zà-ÿа-яё,;] [A-ZÀ-ÞЀ-Я])[^\W\d_]+)")
_MARK = re.compile(r"\s*(?:\([A-Z]\d+\)\s*)+$")
_THAI = re.compile(r"[฀-๿]")


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches between lines without visible characters, outer blanks left out."""
    at = 0
    for part in text.split("\n\n"):
        begin = 0
        for m in [*_GAP.finditer(part), None] if part.count("\n") > 1 else [None]:
            piece = part[begin : m.start() if m else len(part)]
            if visible := piece.strip():
                start = at + begin + piece.index(visible[0])
                yield start, start + len(visible)
            begin = m.end() if m else 0
        at += len(part) + 2


class Memo(dict):
    """A function of a token, remembered for TOKENS of them at a time and never for long ones."""

    def __init__(self, f: Callable[[str], object]) -> None:
        self.f = f

    def __missing__(self, token: str) -> object:
        got = self.f(token)
        if len(token) <= TOKEN_LETTERS:
            if len(self) >= TOKENS:
                self.clear()
            self[token] = got
        return got


def left_word(text: str, start: int, dot: int) -> str:
    """The word before a period, in small letters, without brackets in front of it."""
    far = max(start, dot - TOKEN_LETTERS)
    at = text.rfind(" ", far, dot) + 1
    if (at or far == start) and (word := text[at or far : dot]).isalnum():
        return word.lower()
    at = dot
    while at > start and text[at - 1] not in _BEFORE_WORD:
        at -= 1
    return text[at:dot].lower().strip("'’‘")


def words(tokens: set[str]) -> set[str]:
    """The tokens' runs of letters; the pattern is run only on tokens that have something else within."""
    bare = {t.strip(_EDGES) for t in tokens}
    out = {w for w in bare if w.isalpha()}
    out.update(_WORD.findall(" ".join(bare - out)))
    return out


@Memo
def _dotted(token: str) -> tuple[str, bool, bool, str] | None:
    """Of a token with a period at its end: the word, whether it takes the one before to know it, whether it is a small single letter, the comma behind the period."""
    if token[-1] == ".":
        raw, comma = token[:-1].lstrip(_EDGES), ""
    elif token[-1] in ",;:" and token[-2:-1] == ".":
        raw, comma = token[:-2].lstrip(_EDGES), ","
    else:
        return None
    w = raw.lower()
    if len(w) == 1 and w.isalpha():
        return w, True, raw.islower(), comma
    if len(w) < 3 and w.isdigit():
        return w, True, False, comma
    return (w, False, False, comma) if w[:1].isalpha() else None


def _next_visible(text: str, at: int, end: int) -> int:
    while at < end and text[at].isspace():
        at += 1
    return at


ABBR, STOP, CAP, START = range(4)


def first_words(paras: list[list[str]]) -> set[str]:
    """The words that begin paragraphs, numbers and brackets in front of them left out."""
    out = set()
    for tokens in paras:
        for t in tokens[:3]:
            if (w := t.strip(_EDGES))[:1].isalpha():
                out.add(w)
                break
    return out


@Memo
def _follows(ch: str) -> int | None:
    """What a word's period is by the first letter behind it."""
    return ABBR if ch in ",;:" or ch.islower() or ch.isdigit() else CAP if ch.isupper() else None


def _with_left(w: str, small: bool, before: str) -> tuple[str, bool]:
    """A single letter or short number before a period as it is known by the token before it, and whether it is small letters only."""
    before = before.lstrip(_EDGES)
    if w.isdigit():
        return before.lower() + " #", small
    if len(before) == 2 and before[1] == "." and before[0].isalpha():
        return f"{before[0].lower()}.{w}", small and before[0].islower()
    return w, small


def observed(paras: list[list[str]], begins: Callable[[str], bool] | None = None) -> dict[str, list[int]]:
    """Per word before a period: how often the period is inside a sentence for certain, how often it ends a
    paragraph, how often a capital follows, and how often that capital's word ``begins`` sentences (or stands behind
    small single letters: a name's initials are capitals).

    Initials in a row count as one word (``z.b``), and a number of one or two digits is known by the word before it (``der #``).
    """
    out: dict[str, list[int]] = {}
    for tokens in paras:
        last = len(tokens) - 1
        for i in [i for i, t in enumerate(tokens) if t[-1] in ".,;:" and "." in t[-2:]]:
            if not (known := _dotted[tokens[i]]):
                continue
            w, short, small, after = known
            if not after and i < last:
                after = tokens[i + 1]
            kind = _follows[after[0]] if after else STOP
            if short:
                w, small = _with_left(w, small, tokens[i - 1] if i else "")
                if not w[:1].isalpha():
                    continue
            got = out.get(w)
            if got is None:
                got = out[w] = [0, 0, 0, 0]
            if kind is not None:
                got[kind] += 1
                if kind == CAP and begins and after[-1] != "." and (begins(after.rstrip(_EDGES)) or small):
                    got[START] += 1
    return out


def sure(text: str, paras: list[tuple[int, int]]) -> dict[str, list[int]]:
    """What ``observed`` says of ABBR and STOP, read off the text; capitals, most of what follows periods, are passed over before any word is looked at."""
    out: dict[str, list[int]] = {}
    for start, end in paras:
        for m in _CLOSED.finditer(text, start, end):
            dot, at = m.span()
            kind = ABBR if at - dot > 1 else STOP
            if kind == STOP and at < end:
                kind = _follows[text[_next_visible(text, at + 1, end)]]
                if kind != ABBR:
                    continue
            size = TOKEN_LETTERS
            while len(tokens := text[max(start, dot - size) : at].split()) < 3 and dot - size > start:
                size *= 2  # the first of them may be cut
            if not (known := _dotted[tokens[-1]]):
                continue
            w, short, small, _ = known
            if short:
                w, small = _with_left(w, small, tokens[-2] if len(tokens) > 1 else "")
                if not w[:1].isalpha():
                    continue
            got = out.get(w)
            if got is None:
                got = out[w] = [0, 0]
            got[kind] += 1
    return out


class Evidence:
    """Counts per class of evidence, field and word."""

    FIELDS = {  # "w": words before a period, "n": capitalised words, "o", "c": how Thai paragraphs open and close; "t": all in all
        "w": ("abbr", "stop", "cap", "start", "dotted", "bare"), "n": ("low", "name", "next"), "o": ("open", "piece"), "c": ("close",), "t": ("stop", "cap"),
    }
    WIDTH = 6

    def __init__(self) -> None:
        self.counts = {(k, f): Counter() for k, fields in self.FIELDS.items() for f in range(len(fields))}

    def size(self) -> int:
        return sum(map(len, self.counts.values()))

    def add(self, text: str) -> None:
        """Unambiguous occurrences of one document."""
        c, paras = self.counts, [text[a:b].split() for a, b in paragraphs(text)]
        tokens = set().union(*paras)
        dotted = {t for t in tokens if t[-1] == "."}
        plain, mid = words(tokens - dotted), set(_MID.findall(text))
        low = {w for w in plain | words(dotted) if w[0].islower()}
        firsts, after = first_words(paras), set()

        def begins(word: str) -> bool:
            after.add(small := word.lower())
            return word[1:] == small[1:] and (word in firsts or (small in low and word not in mid))

        fields = [c["w", f] for f in range(self.WIDTH)]
        for word, got in observed(paras, begins).items():
            for f, n in zip(fields, got):
                if n:
                    f[word] += n
            fields[4][word] += 1
            fields[5][word] += word in plain or word.capitalize() in plain
            c["t", 0][""] += got[STOP]
            c["t", 1][""] += got[CAP]
        c["n", 0].update(low)
        c["n", 1].update({w.lower() for w in mid})
        c["n", 2].update(after)
        if not text.isascii() and _THAI.search(text):
            for start, end in paragraphs(text):
                body = text[start:end]
                if len(_THAI.findall(body)) * 3 > len(body):
                    m = _NUMBER.match(body)
                    pieces = body[m.end() if m else 0 :].split()
                    if pieces:
                        c["o", 0][pieces[0][:6]] += 1
                        c["o", 1].update(p[:6] for p in pieces)
                        c["c", 0][pieces[-1][-6:]] += 1

    def rows(self) -> Iterator[tuple[str, str, list[int]]]:
        """(class, word, counts)"""
        for k, fields in self.FIELDS.items():
            got: dict[str, list[int]] = {}
            for f in range(len(fields)):
                for w, n in self.counts[k, f].items():
                    if n:
                        got.setdefault(w, [0] * self.WIDTH)[f] = n
            for w, n in got.items():
                yield k, w, n


# What a verdict says: an abbreviation or not, and whether one may end a sentence; a common word or a name; a Thai opening or closing.
YES, NO, MAY_END, COMMON, NAME, OPEN, CLOSE = 1, 2, 4, 1, 2, 1, 1


def verdict(cls: str, word: str, n: list, share: float) -> int:
    """The corpus's verdict on a word by its counts; 0 if they say nothing. ``share``: of all periods before a capital or at a paragraph's end, the latter.

    A word is an abbreviation if unambiguous occurrences say so three times as often as not, or if it never stands
    without its period and ends paragraphs far less often than words do (a likelihood ratio, the larger the longer the word is).
    """
    if cls == "w":
        abbr, stop, cap, start, dotted, bare = n[:6]
        many, usual = stop + cap, min(max(share, 0.01), 0.99)
        seldom = 0.0
        if many and stop * 8 < usual * many:
            got = stop / many
            seldom = many * ((got * np.log(got / usual) if got else 0.0) + (1 - got) * np.log((1 - got) / (1 - usual)))
        if (abbr >= 2 and abbr > 3 * stop and abbr * 20 > cap) or (seldom > SURE * LETTER ** (2 if word.endswith(" #") else min(len(word), 40)) and bare * 20 <= dotted):
            letters = len(word) == 1 or word[1:2] == "."
            return YES | (MAY_END if start * 4 >= cap > 0 and not (letters and abbr * 20 > cap) else 0)
        return NO if stop else 0
    if cls == "n":
        return (COMMON if n[0] > n[1] else NAME if n[1] else 0) if n[2] else 0
    if cls == "o":
        return OPEN if n[0] >= 3 and n[0] * 50 >= n[1] else 0
    return CLOSE if cls == "c" and n[0] >= 3 else 0


def word_hash(cls: str, word: str) -> int:
    return xxhash.xxh64_intdigest(f"{cls}\x00{word}".encode("utf-8", "surrogatepass"))


class Lexicon:
    """The corpus's verdicts by word: 64-bit hashes, ascending, with a code each. Two words share a verdict with a chance of 2**-64."""

    def __init__(self, hashes: np.ndarray, codes: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.codes = hashes[order], codes[order]
        self.known: dict[tuple[str, str], int] = {}

    @classmethod
    def of(cls, evidence: Evidence) -> Lexicon:
        """Of a corpus that fits into one process."""
        rows = list(evidence.rows())
        stop, cap = next(((n[0], n[1]) for k, _, n in rows if k == "t"), (0, 0))
        got = [(word_hash(k, w), v) for k, w, n in rows if (v := verdict(k, w, n, stop / max(1, stop + cap)))]
        return cls(np.array([h for h, _ in got], np.uint64), np.array([v for _, v in got], np.int8))

    def __call__(self, cls: str, word: str) -> int:
        if (code := self.known.get((cls, word))) is None:
            if len(self.known) > FLUSH:
                self.known.clear()
            h = np.uint64(word_hash(cls, word))
            i = int(np.searchsorted(self.hashes, h))
            code = self.known[cls, word] = int(self.codes[i]) if i < len(self.hashes) and self.hashes[i] == h else 0
        return code


class Document:
    """The units of one document. ``corpus(class, word)`` gives the corpus's verdicts."""

    def __init__(self, text: str, corpus: Callable[[str, str], int]) -> None:
        self.text, self.corpus = text, corpus
        self.paras = list(paragraphs(text))
        self.marks = [x for x in _MARKS if x in text]
        self.thai = not text.isascii() and bool(_THAI.search(text))
        self._own: dict[str, list[int]] | None = None
        self._abbr: dict[tuple[str, bool], bool] = {}
        self._words: set[str] | None = None
        self._mid: set[str] | None = None

    def own(self, word: str) -> tuple[int, int]:
        """Unambiguous occurrences in this document: (abbreviation, end of sentence)."""
        if self._own is None:
            self._own = sure(self.text, self.paras)
        got = self._own.get(word)
        return (got[ABBR], got[STOP]) if got else (0, 0)

    def abbreviation(self, word: str, small: bool) -> bool:
        """By two occurrences in the document that agree, else by the corpus, else by a single other occurrence, else by form.

        ``small``: the occurrence in question is followed by a small letter; it doesn't speak for itself.
        """
        got = self._abbr.get((word, small))
        if got is None:
            got = self._abbr[word, small] = self._abbreviation(word, small)
        return got

    def _abbreviation(self, word: str, small: bool) -> bool:
        if not word[:1].isalpha():
            return False
        abbr, stop = self.own(word)
        if abbr + stop >= 2 and not (abbr and stop):
            return stop == 0
        if code := self.corpus("w", word):
            return bool(code & YES)
        if stop or (abbr and not small):
            return abbr > 0
        return len(word) == 1 or ("." in word and " " not in word)

    def may_end(self, word: str) -> bool:
        """Whether an abbreviation may stand at the end of a sentence: it ends paragraphs of the document, or words that begin paragraphs follow it in the corpus."""
        return self.own(word)[1] > 0 or bool(self.corpus("w", word) & MAY_END)

    def common(self, word: str) -> bool | None:
        """Whether a capitalised word is an ordinary one that stands at the start of a sentence; None if nothing is known."""
        low = word.lower()
        if word[1:] != low[1:]:
            return None
        in_doc, as_name = self._has(low), self._as_name(word)
        if in_doc != as_name:
            return in_doc
        code = self.corpus("n", low)
        return None if code == 0 else code == COMMON

    def _has(self, low: str) -> bool:
        """Whether a word stands in the text; where a search can tell, the words aren't gathered."""
        if self._words is None:
            if len(self.text) < SHORT and low.isalpha():
                if f" {low} " in self.text:
                    return True
                if low not in self.text:
                    return False
            self._words = words(set(self.text.split()))
        return low in self._words

    def _as_name(self, word: str) -> bool:
        """Whether a word stands capitalised behind a small letter or comma."""
        if self._mid is None:
            if len(self.text) < SHORT and f" {word}" not in self.text:
                return False
            self._mid = set(_MID.findall(self.text))
        return word in self._mid

    def ends(self) -> Iterator[int]:
        """End positions of the units, ascending."""
        for start, end in self.paras:
            yield from self._paragraph(start, end)

    def _paragraph(self, start: int, end: int) -> Iterator[int]:
        text = self.text
        unit = start  # where the running unit begins
        cuts = []
        for m in (_TERM if any(text.find(x, start, end) >= 0 for x in self.marks) else _STOP).finditer(text, start, end):
            dot, at = m.span()
            if at <= unit or dot < unit:
                continue
            if at >= end:
                break  # the paragraph's end is an end in any case
            nxt, ch, mark = at, text[at], text[dot]
            while ch.isspace():
                nxt += 1
                ch = text[nxt]
            if at - dot > 1 or not ch.isalnum() or (mark in "!?…" and (mark == "…" or not ch.isupper())):
                at, nxt = self._judge(m, unit, start, end)
            elif mark == ".":  # a single mark before a letter or digit: as _judge has it, without a look at quotes and brackets
                if not text[dot - 1].isalpha() and _NUMBER.fullmatch(text, unit, at):
                    continue
                if not self._period(unit, start, dot, nxt > at, ch, nxt, ch.isupper() or ch.islower()):
                    continue
            if at:
                cuts.append(at)
                unit = nxt
        if self.thai and _THAI.search(text, start, end):
            cuts = sorted({*cuts, *self._thai(start, end, cuts)})
        for c in cuts:
            if c < end:
                yield c
        yield end

    def _judge(self, m: re.Match, unit: int, start: int, end: int) -> tuple[int, int]:
        """(end of the unit, start of the next one) if the terminator ends a unit, else (0, 0)."""
        text, mark, dot, at = self.text, m.group(), m.start(), m.end()
        no = (0, 0)
        # closing quotes and brackets belong to the unit, with a blank before » or ! as is the custom in French
        closed = ""
        while at < end:
            ch, skip = text[at], at
            if ch.isspace() and (j := _next_visible(text, at, end)) < end and text[j] == "»":
                ch, skip = "»", j
            if ch not in CLOSERS or (ch in "\"'“" and not self._closes(ch, unit, skip)):
                break
            closed += ch
            at = skip + 1
        nxt = _next_visible(text, at, end)
        if nxt >= end:
            return no  # the paragraph's end is an end in any case
        blank = nxt > at
        ch = text[nxt]
        if ch in ",;:、，；：)]}）」』":
            return no
        if _MARK.match(text, at, end):
            return no
        if mark[0] == "." and _NUMBER.fullmatch(text, unit, at):
            return no  # a paragraph or claim number belongs to what follows
        opener = nxt
        while opener < end and text[opener] in OPENERS + "—–":
            opener = _next_visible(text, opener + 1, end)
        first = text[opener] if opener < end else ch
        cased = first.isupper() or first.islower()
        inner = self._opened_at(closed, unit, dot) if closed else None
        if inner is not None:
            whole = not text[unit:inner].strip() or bool(_NUMBER.fullmatch(text, unit, inner))
            bracket = closed[0] in ")）]】"
            if not whole and not bracket:  # a quotation within a sentence
                if not cased or first.islower() or mark[0] not in ".…":
                    return no
            elif not whole and (first.islower() or not cased):
                return no
            elif whole and first.islower() and mark[0] not in ".。।":
                return no
            return at, nxt
        if mark[0] in "。！？।؟":
            return at, nxt
        if mark[0] in "!?":
            if dot > start and text[dot - 1].isspace() and (first.islower() or not cased):
                return no  # a sign within a formula
            if first.islower() and self._inside_quote(unit, dot):
                return no
            if not blank and first.isascii() and not first.isupper():
                return no
            return at, nxt
        if mark[0] == "…" or mark.startswith(".."):
            if text[dot - 1 : dot].isspace() or not cased or first.islower() or not blank:
                return no
            return (at, nxt) if self.common(_first_word(text, opener)) else no
        return (at, nxt) if self._period(unit, start, dot, blank, first, opener, cased) else no

    def _period(self, unit: int, start: int, dot: int, blank: bool, first: str, opener: int, cased: bool) -> bool:
        text = self.text
        word = left_word(text, unit, dot)
        if word and word[-1].isdigit() or (word and word[-1] in "%°") or not word:
            if word.isdigit() and len(word) <= 2:
                before = left_word(text, unit, _back(text, dot - len(word), unit))
                ordinal = before + " #"
                if self.abbreviation(ordinal, first.islower()) and not (first.isupper() and self.may_end(ordinal) and self.common(_first_word(text, opener))):
                    return False
            if not blank:
                return not first.isdigit() and not (first.islower() and first.isascii()) and (not first.isupper() or _small_next(text, opener))
            return not first.isdigit() and first not in "−-+=/·*"
        if len(word) == 1 and (joined := _INITIAL.search(text, max(unit, dot - 6), dot)):
            word = f"{joined[1].lower()}.{word}"
        if not blank:  # a missing blank
            if cased and not (first.isupper() and _small_next(text, opener)):
                return False
            if ("." in word and not self.may_end(word)) or len(word) < 2 or first.isdigit():
                return False
        if not self.abbreviation(word, first.islower()):
            return True
        if first.islower() or first.isdigit() or not self.may_end(word):
            return False
        if not first.isupper():
            return True
        known = self.common(_first_word(text, opener))
        return known is True or (known is None and not any(self.own(word)))

    def _closes(self, ch: str, unit: int, at: int) -> bool:
        """Whether a mark that opens and closes alike closes here."""
        seen = self.text[unit:at]
        if ch == "“":
            return seen.count("„") > seen.count("“")
        if ch == "'":
            return False
        return seen.count(ch) % 2 == 1

    def _opened_at(self, closed: str, unit: int, dot: int) -> int | None:
        """Where the outermost of the marks just closed was opened, within the unit."""
        text, best = self.text, None
        for ch in closed:
            for p in PARTNERS.get(ch, ch):
                i = text.rfind(p, unit, dot if best is None else best)
                if i >= 0:
                    best = i
                    break
        return best

    def _inside_quote(self, unit: int, dot: int) -> bool:
        seen = self.text[unit:dot]
        return any(seen.count(o) > seen.count(c) for o, c in ("«»", "“”", "「」", "『』")) or seen.count('"') % 2 == 1 or seen.count("„") > seen.count("“") + seen.count("”")

    def _thai(self, start: int, end: int, cuts: list[int]) -> Iterator[int]:
        """Blanks that end a Thai sentence: the piece before can end one and the piece behind begins one."""
        text, corpus = self.text, self.corpus
        body = text[start:end]
        if len(_THAI.findall(body)) * 3 <= len(body):
            return
        m = _NUMBER.match(body)
        at = start + (m.end() if m else 0)
        spans = [(at + x.start(), at + x.end()) for x in re.finditer(r"\S+", text[at:end])]
        unit = at
        for (a, b), (c, d) in zip(spans, spans[1:]):
            left, right = text[a:b], text[c:d]
            if not _THAI.match(left[-1]) or text.count('"', unit, b) % 2:
                if not (left[-1] in ")»”" and corpus("o", right[:6])):
                    continue
            if left.endswith(THAI_FINAL) or (corpus("o", right[:6]) and (corpus("c", left[-6:]) or len(left) > 12)):
                if right in ("ฯลฯ", "ก็ได้") or right.startswith(("ฯลฯ", "และ", "หรือ", "แล้ว", "โดยที่", "ซึ่ง")):
                    continue
                yield b
                unit = c


def _first_word(text: str, at: int) -> str:
    m = _WORD.match(text, at)
    return m.group() if m else ""


def _small_next(text: str, at: int) -> bool:
    return at + 1 < len(text) and text[at + 1].islower() or text[at : at + 2] in ("A ", "I ", "È ", "Y ", "О ", "В ", "И ")


def _back(text: str, at: int, unit: int) -> int:
    while at > unit and text[at - 1].isspace():
        at -= 1
    return at


def _gather(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(e: Evidence) -> pa.RecordBatch:
        rows = list(e.rows())
        counts = np.array([n for _, _, n in rows], np.int64).reshape(-1, Evidence.WIDTH)
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in rows], pa.string()), pa.array([w.encode("utf-8", "surrogatepass") for _, w, _ in rows], pa.binary()), *map(pa.array, counts.T)],
            names=["cls", "word", *_COUNTS],
        )

    e = Evidence()
    for b in stream:
        for text in b.column("text").to_pylist():
            e.add(text)
            if e.size() > FLUSH:
                yield flush(e)
                e = Evidence()
    yield flush(e)


_COUNTS = [f"n{i}" for i in range(Evidence.WIDTH)]


def _verdicts(share: float):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            counts = np.stack([b.column(c).to_numpy() for c in _COUNTS], axis=1).tolist()
            rows = [(k, w, v) for k, w, n in zip(b.column("cls").to_pylist(), b.column("word").to_pylist(), counts) if (v := verdict(k, w.decode("utf-8", "surrogatepass"), n, share))]
            hashes = [xxhash.xxh64_intdigest(k.encode() + b"\0" + w) for k, w, _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array([v for _, _, v in rows], pa.int8())], names=["h", "code"])

    return run


def corpus_verdicts(documents: DataFrame) -> DataFrame:
    """(h, code): the verdicts on all words of which the documents say something, by 64-bit hash; counted exactly, one row a word is shuffled per flush."""
    rows = documents.where(F.length("text") > 0).select("text").mapInArrow(_gather, "cls STRING, word BINARY, " + ", ".join(f"{c} BIGINT" for c in _COUNTS))
    summed = cut(rows.groupBy("cls", "word").agg(*[F.sum(c).alias(c) for c in _COUNTS]))
    stop, cap = (int(x or 0) for x in summed.where(F.col("cls") == "t").agg(F.sum("n0"), F.sum("n1")).first())
    said = (F.col("cls") != "n") | (F.col("n2") > 0)
    return summed.where(said).mapInArrow(_verdicts(stop / max(1, stop + cap)), "h BIGINT, code TINYINT")


def _lexicon(table: pa.Table) -> Lexicon:
    return Lexicon(table.column("h").to_numpy().view(np.uint64), table.column("code").to_numpy())


def corpus_lexicon(documents: DataFrame) -> Lexicon:
    """All verdicts of a corpus in one process."""
    return _lexicon(corpus_verdicts(documents).toArrow())


def _units(ids: list, texts: list[str], lexicons: Iterator[Callable[[str, str], int]]) -> pa.RecordBatch:
    out_ids, out_ends = [], []
    for i, text, corpus in zip(ids, texts, lexicons):
        got = list(Document(text, corpus).ends())
        out_ids += [i] * len(got)
        out_ends += got
    return pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out_ends, pa.int32())], names=["doc_id", "end_char"])


def _split(hashes: np.ndarray, codes: np.ndarray):
    """Splits documents by verdicts that are all here."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(hashes, codes)
        for b in stream:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                yield _units(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), iter(lambda: lexicon, None))

    return run


def _asked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, h): the words whose verdicts a document may ask for, whatever the answers are."""
    for b in stream:
        rows, hashes = [], []
        for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist()):
            got = set()
            tokens = text.split()
            for w in observed([text[x:y].split() for x, y in paragraphs(text)]):
                got.add(word_hash("w", w))
            for m in re.finditer(r"[.…]", text):
                word = left_word(text, 0, m.start())
                got |= {word_hash("w", word), word_hash("w", word.rstrip("0123456789"))}
                if word.isdigit():
                    got.add(word_hash("w", left_word(text, 0, _back(text, m.start() - len(word), 0)) + " #"))
                if len(word) == 1 and (joined := _INITIAL.search(text, max(0, m.start() - 6), m.start())):
                    got.add(word_hash("w", f"{joined[1].lower()}.{word}"))
            got |= {word_hash("n", w.lower()) for t in tokens if t[0].isupper() or not t[0].isalpha() for w in _WORD.findall(t)}
            if _THAI.search(text):
                got |= {word_hash("o", t[:6]) for t in tokens} | {word_hash("c", t[-6:]) for t in tokens}
            rows += [row] * len(got)
            hashes += got
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.array(hashes, np.uint64).view(np.int64))], names=["row", "h"])


def _split_joined(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in stream:
        for s in range(0, b.num_rows, 500):
            part = b.slice(s, 500)
            told = ({x["h"] & 0xFFFFFFFFFFFFFFFF: x["code"] for x in v or ()} for v in part.column("verdicts").to_pylist())
            lexicons = (lambda cls, word, t=t: t.get(word_hash(cls, word), 0) for t in told)
            yield _units(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), lexicons)


def sentence_ends(documents: DataFrame, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, end_char): one row per unit, the characters from the text's start through the unit's last one.

    Units are sentences, and headings or claims that stand as their own paragraph. Null, empty and blank
    texts have none. Positions count code points; the ``lang`` column isn't used, since it may be wrong.
    More than ``lexicon_words`` verdicts are joined to the documents instead of being sent to every task.
    """
    docs = documents.where(F.length("text") > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    verdicts = cut(corpus_verdicts(docs))
    schema = "doc_id BIGINT, end_char INT"
    if verdicts.count() <= lexicon_words:
        table = verdicts.toArrow()
        return docs.mapInArrow(_split(table.column("h").to_numpy().view(np.uint64), table.column("code").to_numpy()), schema)
    rows = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    told = rows.select("row", "text").mapInArrow(_asked, "row BIGINT, h BIGINT").join(verdicts, "h")
    per_row = told.groupBy("row").agg(F.collect_list(F.struct("h", "code")).alias("verdicts"))  # a document's own words
    return rows.join(per_row, "row", "left").select("doc_id", "text", "verdicts").mapInArrow(_split_joined, schema)
