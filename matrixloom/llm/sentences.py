"""Problem 8: sentence units of texts in any language, by a pushdown automaton over quotations, brackets and lists."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .space import batches

# Abbreviations after which a sentence goes on whatever follows, without their last full stop.
INSIDE = frozenset(
    "al dr dra prof profa mr mrs ms mx st sr sra herr hr mme mlle mm m dipl gen capt rev hon e.g i.e eg ie cf vs viz approx ca incl excl resp "
    "z.b d.h u.a bzw vgl ggf evtl inkl exkl sog bspw p.ej p.ex ej ex aprox env c.-à-d càd т.е т.к см ср ок д-р проф им напр डॉ श्री د أ".split()
) | frozenset(["et al", "z. b", "d. h", "u. a", "o. ä", "s. o", "s. u", "i. d. r", "p. ej", "p. ex", "c.-à.-d", "т. е", "т. к"])
# Abbreviations after which a sentence goes on if a number follows.
NUMBERED = frozenset(
    "fig figs tab tabs sec secs eq eqs no nos nr nrn vol ch chap app art p pp pg abb abs kap bd s seite nº n núm num pág págs cap v rm ref refs "
    "рис табл стр с гл п № т vers ver rev bench room lot".split()
)
# Abbreviations that may end a sentence; it is over if what follows starts one.
EITHER = frozenset(
    "etc usw usf u.s.w inc ltd co corp jr a.m p.m am pm r.p.m rpm min max var std sec hrs hr h s avg med dept est jan feb mar apr jun jul aug sep sept oct nov dec "
    "min. std. tel u.k u.s u.s.a e.u ph.d m.sc b.sc т. д т.д т. п т.п др г гг в вв тыс млн млрд руб мин сек ч кг мг мл "
    "pts ud uds ee.uu".split()
) | frozenset(["т. д", "т. п", "и т. д", "и т. п"])
# Words that, in scripts without capitals, tell that a sentence goes on after a quotation.
GOES_ON = {
    "Han": ("然后", "随后", "接着", "之后", "后", "并", "便", "就", "的", "说", "问", "道", "写", "而", "但", "才", "等"),
    "Kana": ("と", "って", "という", "は", "が", "を", "に", "の", "も", "で", "から", "まで", "など", "や", "へ"),
    "Arabic": ("ثم", "وقال", "قال", "قالت", "سأل", "وسأل", "أجاب", "وأضاف", "قبل", "بعد", "عندما", "كما", "و"),
}
SAYING_HI = ("पूछा", "कहा", "बोला", "बोली", "बोले", "बताया", "लिखा", "चिल्लाया", "सोचा")
GERMAN_ORDINAL = frozenset("am im vom zum beim der die das den dem des ab bis seit nach vor".split())
INITIAL_AFTER = frozenset("by von de del della di da du van der den la le par por and und y et и with from mit para pour".split())
# Words that a single letter follows as a label, so that it is no initial.
LETTERED = frozenset("phase fase фаза фазе фазу group gruppe groupe grupo type typ tipo class klasse classe clase plate platte row reihe gate step".split())

OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "〔": "〕", "《": "》", "〈": "〉", "「": "」", "『": "』", "“": "”", "«": "»", "„": "“", "‘": "’", "‚": "‘", "‹": "›", '"': '"'}
CLOSE = frozenset(OPEN.values()) | {"”", "’"}
#: Which opening marks a closing mark can close.
CLOSED_BY = {c: "".join(o for o, x in OPEN.items() if x == c) for c in CLOSE} | {"”": "“„", "“": "„", "»": "«", "«": "»", "’": "‘‚", "‘": "‚"}
BRACKETS = frozenset("([{（【〔")
FULL = "。！？｡।॥؟!?‼⁇⁈⁉"
ENDS = frozenset(FULL + ".．…")
# Characters that show nothing and may stand within a word.
HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_EVENT = re.compile(r"[.．…。！？｡।॥؟!?‼⁇⁈⁉()\[\]{}（）【】〔〕《》〈〉「」『』“”«»„‘’‚‹›\"]")
_PAIRS = re.compile(r"[()\[\]{}（）【】〔〕《》〈〉「」『』“”«»„‘’‚‹›\"]")
_THAI = regex.compile(r"\p{Thai}")
_LINE = re.compile(r"\r\n|\n|\r|\Z")
_MARK = re.compile(r"[^\S\r\n]*(?:[-*]|\d+\.) ")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_'’\-]+")
# A word in small letters that starts a sentence all the same: mt-encoded, p-values, log-counts, iPlate, pH.
_SMALL_START = regex.compile(r"(?:mt|p|log|q|t|k|x|y|z|e)-\p{L}{2,}|\p{Ll}{1,2}\p{Lu}|mt-\p{Lu}")
_DOTTED = regex.compile(r"(?:\p{L}\.)+\p{L}\Z")
_KANA, _HAN, _ARABIC, _NAGARI = (regex.compile(x) for x in (r"[\p{Hiragana}\p{Katakana}]", r"\p{Han}", r"\p{Arabic}", r"\p{Devanagari}"))
_LETTERS, _FULL_NAGARI = regex.compile(r"[\p{L}\p{M}]+"), regex.compile(r"[।॥!?.]")
# What runs up to a full stop without a space, read from its end.
_TOKEN = regex.compile(rf"(?r)[\p{{L}}\p{{N}}\p{{M}}_.\-'’{HIDDEN}]+")
_AFTER_ORDINAL, _VOWEL = regex.compile(r"The|In|We|A\b"), regex.compile(r"[aeiouyäöüáéíóúàèêâîôûаеёиоуыэюя\p{N}]")
_HIDDEN = re.compile(f"[{HIDDEN}]")


#: Characters looked back at most for what a mark depends on, so that time stays linear in the text.
BACK = 200


class Trie:
    """Abbreviations by their letters from the last to the first, each with its kind."""

    def __init__(self, kinds: dict[str, frozenset[str]]):
        self.root: dict = {}
        for kind, words in kinds.items():
            for w in words:
                node = self.root
                for ch in reversed(w):
                    node = node.setdefault(ch, {})
                node.setdefault("", kind)

    def before(self, text: str, dot: int, start: int) -> str | None:
        """The kind of the longest abbreviation that ends before the full stop at ``dot``."""
        node, i, found = self.root, dot - 1, None
        while i >= start:
            ch = text[i]
            if ch in HIDDEN:
                i -= 1
                continue
            ch = " " if ch.isspace() else ch.lower()
            node = node.get(ch if len(ch) == 1 else ch[0])
            if node is None:
                break
            if "" in node and (i == start or not (text[i - 1].isalnum() or text[i - 1] in "-_." or text[i - 1] in HIDDEN)):
                found = node[""]
            i -= 1
            if ch == " ":  # a wrapped or doubled space
                while i >= start and text[i].isspace():
                    i -= 1
        return found


TRIE = Trie({"inside": INSIDE, "numbered": NUMBERED, "either": EITHER})


def _pairs(t: str, lo: int, hi: int, stack: list[tuple[str, int]]) -> dict[int, int]:
    """Places of opening marks in t[lo:hi] to those of the marks that close them; what never closes counts for nothing.

    ``stack`` holds the open list levels; quotations and brackets are pushed onto them and never close across one.
    """
    base = len(stack)
    held: Counter[str] = Counter()
    out: dict[int, int] = {}
    for m in _PAIRS.finditer(t, lo, hi):
        i, ch = m.start(), m.group()
        prev = t[i - 1] if i > lo else " "
        nxt = t[i + 1] if i + 1 < hi else " "
        if ch in "’‘" and prev.isalnum() and nxt.isalnum():
            continue  # an apostrophe
        if ch == '"':
            opens = not held['"'] or (prev.isspace() and not nxt.isspace() and stack[-1][0] != '"')
        elif ch == "“":
            opens = not held["„"]
        elif ch == "‘":
            opens = not held["‚"]
        elif ch == "»" and not held["«"]:
            opens = (prev.isspace() or prev in "([") and not nxt.isspace()
        elif ch == "«" and held["»"]:
            opens = False
        else:
            opens = ch in OPEN
        if opens:
            stack.append((ch, i))
            held[ch] += 1
            continue
        if not any(held[o] for o in CLOSED_BY.get(ch, ())):
            continue
        for k in range(len(stack) - 1, base - 1, -1):
            if stack[k][0] in CLOSED_BY[ch]:
                out[stack[k][1]] = i
                for o, _ in stack[k:]:
                    held[o] -= 1
                del stack[k:]
                break
    del stack[base:]
    return out


def _blocks(t: str, stack: list[tuple[str, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, after the list mark, end) of every run of lines without a blank line or list item between.

    ``stack`` has the list levels open in the block, each with its indentation: an item closes those indented as far or further and
    opens its own, a blank line closes all.
    """
    block: list[int] = []
    pos, n = 0, len(t)
    while pos < n:
        m = _LINE.search(t, pos)
        end, after = m.start(), m.end()
        mark = _MARK.match(t, pos, end)
        blank = not mark and not t[pos:end].strip()
        if block and (blank or mark):
            yield block[0], block[1], block[2]
            block = []
        if blank:
            stack.clear()
        elif mark:
            width = len(mark.group()) - len(mark.group().lstrip())
            while stack and stack[-1][1] >= width:
                stack.pop()
            stack.append((mark.group().strip(), width))
            block = [pos, mark.end(), end]
        elif block:
            block[2] = end
        else:
            block = [pos, pos, end]
        pos = after if after > pos else n
    if block:
        yield block[0], block[1], block[2]


def _skip(t: str, i: int, hi: int) -> int:
    while i < hi and t[i].isspace():
        i += 1
    return i


def _starts(t: str, i: int, hi: int) -> bool:
    """Can a sentence start at i, judged by its first letters?"""
    while i < hi and (t[i] in OPEN or t[i] in "¿¡—–-*_`" or t[i].isspace()):
        i += 1
    if i >= hi:
        return True
    ch = t[i]
    return ch.isupper() or ch.istitle() or (ch.isalpha() and not ch.islower()) or bool(_SMALL_START.match(t, i))


def _after_quote(t: str, o: int, c: int, hi: int, at_start: bool) -> bool:
    """Is the sentence over with the quotation or bracket t[o:c+1], whose own sentence is over?"""
    j = c + 1
    while j < hi and t[j] in CLOSE and t[j] not in OPEN:
        j += 1
    i = _skip(t, j, hi)
    if i >= hi:
        return True
    ch = t[i]
    if t[o] in BRACKETS and not at_start:
        return False
    if ch in ENDS or ch in ",;:،؛、，；：·/":
        return False
    if ch in "—–-":
        k = _skip(t, i + 1, hi)
        return not (k < hi and t[k].islower())
    if ch.islower():
        return bool(_SMALL_START.match(t, i))
    if ch.isupper() or ch.istitle() or ch in OPEN or ch in "¿¡":
        return True
    if not ch.isalpha():
        return ch.isspace() or not ch.isnumeric() or i > j
    rest = t[i : i + 12]
    if _KANA.match(ch):
        return not rest.startswith(GOES_ON["Kana"])
    if _HAN.match(ch):
        return not rest.startswith(GOES_ON["Han"])
    if _ARABIC.match(ch):
        word = _LETTERS.match(t, i).group()
        return word not in GOES_ON["Arabic"]
    if _NAGARI.match(ch):
        m = _FULL_NAGARI.search(t, i, hi)
        return not any(w in t[i : m.start() if m else hi] for w in SAYING_HI)
    return True


def _labelled(t: str, lo: int, k: int, token: str) -> bool:
    """Is the single letter before which t[lo:k] stands a label or a unit, and so no initial?"""
    if len(token) != 1:
        return False
    if k > lo and t[k - 1] == "°":
        return True
    words = t[max(lo, k - BACK) : k].split()
    return bool(words) and words[-1].lower() in LETTERED


def _full_stop(t: str, lo: int, dot: int, hi: int) -> bool:
    """Does the single full stop at ``dot`` end the sentence that began at ``lo``?"""
    prev = t[dot - 1] if dot > lo else " "
    j = dot + 1
    nxt = t[j] if j < hi else ""
    if nxt and (nxt.isnumeric() or nxt in "_/\\@=-"):
        return False
    if prev.isspace() and nxt and not nxt.isspace():
        return False
    if nxt and nxt in ",;:،؛、，；：":
        return False
    m = _TOKEN.match(t, max(lo, dot - BACK), dot)
    k = m.start() if m else dot
    token = t[k:dot] if t.isascii() else _HIDDEN.sub("", t[k:dot])
    if nxt and not nxt.isspace() and nxt not in CLOSE and nxt not in OPEN:
        if nxt.islower():
            m = _SMALL_START.match(t, j)
            word = _WORD.match(t, j)
            return bool(m) and len(token) > 1 and word.end() < hi and t[word.end()].isspace()
        if not nxt.isalpha():
            return nxt in "¿¡—–"
        if nxt.isupper():
            tail = token.rpartition(".")[2]
            if tail.isupper() and tail.isalpha() and len(tail) < 2 and not _labelled(t, lo, k, token):
                return False
            if TRIE.before(t, dot, lo) == "inside":
                return False
            m = _WORD.match(t, j)
            word = m.group() if m else nxt
            if "_" in token and not (m and m.end() < hi and t[m.end()].isspace()):
                return False
            return len(word) == 1 or any(c.islower() for c in word[1:]) or any(c.isnumeric() for c in word) or len(tail) > 3
        return TRIE.before(t, dot, lo) is None  # a script without capitals
    i = j
    while i < hi and t[i] in CLOSE and t[i] not in OPEN:
        i += 1
    i = _skip(t, i, hi)
    if i >= hi:
        return True
    kind = TRIE.before(t, dot, lo)
    if kind == "inside":
        return False
    first = t[i]
    if first in ",;:،؛、，；：":
        return False
    if kind == "numbered":
        m = _WORD.match(t, i)
        if first.isnumeric() or (m and any(c.isnumeric() for c in m.group()) and len(m.group()) <= 4):
            return False
        if len(token) > 1:
            return _starts(t, i, hi)
    if len(token) == 1 and token.isalpha():
        if i + 1 < hi and t[i + 1] == "." and (f"{token.lower()}. {first.lower()}" in INSIDE or f"{token.lower()}. {first.lower()}" in EITHER):
            return False  # parts of one abbreviation
        if token.isupper() and first.isupper():
            # an initial at the start, after another one or a title, or after a word that names take
            before = t[max(lo, k - BACK) : k].rstrip()
            if not before.strip("\"'“„«‘([（¿¡—- ") or _MARK.fullmatch(t, max(lo, k - BACK), k):
                return False
            last = before.split()[-1]
            if _labelled(t, lo, k, token):
                return True
            if i + 1 < hi and t[i + 1] == ".":
                return False
            if last.endswith(".") and (len(last) == 2 and last[0].isupper() or TRIE.before(before, len(before) - 1, 0) == "inside"):
                return False
            return last.lower() not in INITIAL_AFTER
        if kind == "either":
            return _starts(t, i, hi)
        return token.isupper() or first.isupper() or not first.isalpha()
    if kind == "either" or _DOTTED.match(token):
        if token.lower() == "min" and token[0] == "M" and first.isupper():
            # minutes in a language that writes nouns with capitals: over only if an article or the like follows
            m = _WORD.match(t, i)
            return bool(m) and m.group() in ("Der", "Die", "Das", "Ein", "Eine", "Es", "Er", "Sie", "Wir", "Im", "In", "Am", "Jede", "Warum", "Bitte", "Nichts", "Abb", "Dr", "The")
        return _starts(t, i, hi)
    if token.isnumeric():
        before = t[max(lo, k - BACK) : k].split()
        if before and before[-1].lower() in GERMAN_ORDINAL and len(token) <= 2 and first.isalpha() and not _AFTER_ORDINAL.match(t, i):
            return False
        return not (first.islower() and before and before[-1].lower() in GERMAN_ORDINAL)
    if first.islower() and 1 < len(token) <= 4 and not _VOWEL.search(token.lower()):
        return False  # short and without a vowel: an abbreviation, though not a known one
    return True


def spans(t: str) -> list[tuple[int, int]]:
    """The units of a text as (start, end) in code points, end exclusive, without outer white space.

    One stack holds the open list levels and, above them, the open quotations and brackets of a block (lines up to a blank line
    or the next list item). The control runs over the marks of the block; marks within a pair are passed over, and when
    the pair closes it is told whether the sentence is over with it.
    """
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for begin, body, hi in _blocks(t, stack):
        pairs = _pairs(t, body, hi, stack)
        thai = _THAI.search(t, body, hi) is not None
        event = _EVENT_THAI if thai else _EVENT
        lo = _skip(t, begin, hi)
        pos = max(body, lo)
        is_thai, looked = False, lo

        def cut(end: int) -> None:
            nonlocal lo, pos, is_thai, looked
            while end < hi and t[end] in CLOSE and end not in pairs:
                end += 1
            out.append((lo, end))
            lo = pos = looked = _skip(t, end, hi)
            is_thai = False

        while pos < hi:
            m = event.search(t, pos, hi)
            if not m:
                break
            i, ch = m.start(), m.group()
            if ch.isspace():
                pos = m.end()
                is_thai = is_thai or _THAI.search(t, looked, i) is not None
                looked = i
                if is_thai and _skip(t, i, hi) < hi and "\n" not in ch and "\r" not in ch:
                    cut(i)
                continue
            if ch not in ENDS:
                c = pairs.get(i)
                pos = i + 1
                if c is None:
                    continue
                k = c - 1
                while k > i and (t[k].isspace() or t[k] in CLOSE):
                    k -= 1
                over = k > i and t[k] in ENDS and not (t[k] == "." and t[k - 1] != "." and not _full_stop(t, i + 1, k, k + 1))
                at_start = i - lo < BACK and not t[max(lo, body) : i].strip("¿¡—–-*_`\"'“„«‘ \t\r\n")
                pos = c + 1
                if over and _after_quote(t, i, c, hi, at_start):
                    cut(c + 1)
                continue
            e = i + 1
            while e < hi and t[e] in ENDS:
                e += 1
            run = t[i:e]
            while e < hi and t[e] in CLOSE and e not in pairs and t[e] not in OPEN:
                e += 1
            pos = e
            nxt = t[e] if e < hi else ""
            if any(c in FULL for c in run):
                if run[0] in "!?" and nxt and (nxt in "=" or nxt.isnumeric() or (nxt.islower() and not _SMALL_START.match(t, e))):
                    continue
                k = _skip(t, e, hi)
                if k < hi and t[k] in ",;:，；：、،؛":
                    continue
                if k < hi and t[k] in "—–" and k + 1 < hi:
                    j = _skip(t, k + 1, hi)
                    if j < hi and t[j].islower():
                        continue
                cut(e)
            elif run == "．":
                if not (nxt and nxt.isnumeric() and i > lo and t[i - 1].isnumeric()):
                    cut(e)
            elif len(run) > 1 or "…" in run:
                k = _skip(t, e, hi)
                if k >= hi or ((t[k].isupper() or t[k].istitle() or t[k] in OPEN or t[k] in "¿¡") and i > lo):
                    cut(e)
            elif _full_stop(t, lo, i, hi):
                cut(e)
        if lo < hi:
            end = hi
            while end > lo and t[end - 1].isspace():
                end -= 1
            if end > lo:
                out.append((lo, end))
    return out


_EVENT_THAI = re.compile(r"\s+|" + _EVENT.pattern)


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The sentence units of every text: (key, char_start, char_end).

    Offsets count code points from 0, ends are exclusive. Null, empty and blank texts have no units; texts of
    any length are gone through whole, in time linear in it; repeated rows give repeated units; other
    columns are ignored. Nothing is shuffled.
    """

    def run(t: pa.Table) -> pa.Table:
        found = [spans(s) for s in t[text].to_pylist()]
        n = np.array([len(x) for x in found], int)
        flat = np.array([p for x in found for p in x], np.int64).reshape(-1, 2)
        ids = t[key].take(pa.array(np.repeat(np.arange(len(n)), n)))
        return pa.table([ids, pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=[key, "char_start", "char_end"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.where(F.col(text).isNotNull()).select(key, text).mapInArrow(lambda it: batches(run, it), f"{key} {kind}, char_start long, char_end long")
