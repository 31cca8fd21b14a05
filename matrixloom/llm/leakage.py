"""Problem 6: evaluation texts in documents, found by hash joins of template windows."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.relational import written
from .space import batches

#: Bits (as a power of 2, here 8 MB) of the map of test hashes that is sent along to prune document windows before the join.
MAP_BITS = 26
#: Characters of a text handled at a time; longer texts are cut into overlapping segments.
SEGMENT = 500_000


def letters(text: str) -> str:
    """NFKC, lower case, letters and numbers only."""
    return regex.sub(r"[^\p{L}\p{N}]+", "", unicodedata.normalize("NFKC", text).lower())


def typed(s: str) -> str:
    """Every character of a number as the placeholder ``#``; keeps lengths, so that places agree."""
    return regex.sub(r"\p{N}", "#", s)


def _slide(op, a: np.ndarray, w: int) -> np.ndarray:
    """op over every run of w elements."""
    done, out = 1, a
    while done * 2 <= w:
        out = op(out[:-done], out[done:])
        done *= 2
    return op(out[: len(out) - (w - done)], out[w - done :]) if done < w else out


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k codes, at least 1. Built by doubling, as k is a sum of powers of two."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        level, length, factor = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), 1, base
        out, have = None, 0
        while length <= k:
            if k & length:
                if out is None:
                    out, have = level, length
                else:
                    n = max(0, len(codes) - (have + length) + 1)
                    out = level[:n] * np.uint64(pow(base, have, 1 << 64)) + out[length : length + n]
                    have += length
            n = max(0, len(level) - length)
            level = level[:n] * np.uint64(factor) + level[length : length + n]
            factor = factor * factor % (1 << 64)
            length *= 2
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (out ^ (out >> np.uint64(29))) | np.uint64(1)


class Windows:
    """Template windows of ``k`` characters so chosen that every run of ``need`` characters holds one.

    Of every ``need - k + 1`` neighbouring windows the one with the smallest hash is taken. The choice
    depends on the characters of the run alone, so two texts that share a run share a chosen window
    in it. With ``need - k`` characters around it a window tells whether the run is as long as needed.
    """

    def __init__(self, need: int):
        self.need, self.k = need, need * 3 // 4
        self.w, self.pad = need - self.k + 1, need - self.k

    def of(self, texts: list[str], filler: str, only: HashMap | None) -> tuple[list[int], np.ndarray, list[str]]:
        """Chosen windows of normalised texts: text number, hash, window with what is around it.

        ``only``: known hashes; others are dropped at once. What lies beyond a text is ``filler``.
        """
        who, at, parts = [], [], []
        for i, s in enumerate(texts):
            for j in range(0, max(len(s) - 2 * self.need, 1), SEGMENT):
                if len(s) - j >= self.need:
                    who.append(i)
                    at.append(j)
                    parts.append(s[j : j + SEGMENT + 2 * self.need])
        rows: list[int] = []
        hashes: list[np.ndarray] = []
        shown: list[str] = []
        lo = 0
        while lo < len(parts):
            hi, n = lo, 0
            while hi < len(parts) and (hi == lo or n + len(parts[hi]) < SEGMENT):
                n += len(parts[hi])
                hi += 1
            joined = "\0".join(parts[lo:hi])
            starts = np.cumsum([0] + [len(p) + 1 for p in parts[lo:hi]])[:-1]
            codes = np.frombuffer(typed(joined).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            h = _hashes(codes, self.k)
            gaps = np.concatenate([[0], np.cumsum(codes == 0)])
            low = _slide(np.minimum, h, self.w)
            span = self.need
            low[(gaps[span : span + len(low)] - gaps[: len(low)]) > 0] = 0
            edge = np.zeros(self.w - 1, np.uint64)
            top = _slide(np.maximum, np.concatenate([edge, low, edge]), self.w)
            chosen = np.nonzero(top == h)[0]
            signed = h[chosen].view(np.int64)
            if only is not None:
                hit = only.holds(signed)
                chosen, signed = chosen[hit], signed[hit]
            part = np.searchsorted(starts, chosen, "right") - 1
            for c, p in zip(chosen - starts[part], part, strict=True):
                i, pos = who[lo + p], int(c) + at[lo + p]
                s = texts[i]
                left, right = s[max(pos - self.pad, 0) : pos], s[pos + self.k : pos + self.k + self.pad]
                rows.append(i)
                shown.append(left.rjust(self.pad, filler) + s[pos : pos + self.k] + right.ljust(self.pad, filler))
            hashes.append(signed)
            lo = hi
        return rows, np.concatenate(hashes) if hashes else np.zeros(0, np.int64), shown


def windows(df: DataFrame, key: str, text: str, needs: list[int], filler: str, only: HashMap | None = None) -> DataFrame:
    """(key, need, hash, shown) of the chosen windows of every text; null texts give none."""

    def run(t: pa.Table) -> pa.Table:
        texts = [letters(s) for s in t[text].to_pylist()]
        ids, out = t[key], []
        for need in needs:
            who, h, shown = Windows(need).of(texts, filler, only)
            out.append(pa.table([ids.take(pa.array(who, pa.int64())), pa.array(np.full(len(h), need), pa.int32()), pa.array(h, pa.int64()), pa.array(shown, pa.string())], names=[key, "need", "hash", "shown"]))
        return pa.concat_tables(out)

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(lambda it: batches(run, it), f"{key} {kind}, need int, hash long, shown string")


def leaks(documents: DataFrame, items: DataFrame, need: int = 60, dense_need: int = 24, dense: tuple[str, ...] = ("zh", "ja")) -> DataFrame:
    """Documents that share an unbroken run with a test item: (doc_id, item_id, n_windows).

    Texts are brought to NFKC and lower case and all but letters and numbers is dropped; a pair comes
    out if the results share ``need`` characters in a row, or ``dense_need`` if the item's ``lang`` is one of
    ``dense``. Exact: template windows with numbers as placeholders give the candidates and none is
    missed; the slots are then checked for the same values and the run for its length.
    ``n_windows``: chosen windows within such runs. Null, empty and shorter texts are in no pair; texts
    of any length are gone through whole; repeated ids count as one; other columns are ignored.

    Windows of documents without a match among the windows of the items are dropped before anything is
    shuffled, by a map of the items' hashes whose size does not depend on them; the rest are joined by hash.
    """
    is_dense = F.coalesce(F.col("lang").isin(*dense), F.lit(False))
    theirs = windows(items.where(~is_dense), "item_id", "item_text", [need], "\x02").unionByName(
        windows(items.where(is_dense), "item_id", "item_text", [dense_need], "\x02")
    )
    only = hash_map(theirs)
    ours = windows(documents, "doc_id", "text", [need, dense_need], "\x01", only)
    d, i = ours.alias("d"), theirs.alias("i")
    both = d.join(i, ["need", "hash"]).select("doc_id", "item_id", "need", F.col("d.shown").alias("a"), F.col("i.shown").alias("b"))
    run = F.exists(
        F.sequence(F.lit(1), F.length("a") - F.col("need") + 1),
        lambda s: F.substring(F.col("a"), s, F.col("need")) == F.substring(F.col("b"), s, F.col("need")),
    )
    return both.where(run).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_windows"))


class HashMap:
    """A bit for the leading bits of every known hash, behind a broadcast variable; of one size whatever their number."""

    def __init__(self, sent):
        self.sent = sent

    def holds(self, signed: np.ndarray) -> np.ndarray:
        """False for hashes that are not known for certain."""
        p = (signed.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
        return ((self.sent.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)


def hash_map(hashes: DataFrame) -> HashMap:
    """The map of a ``hash`` column, put together from blocks of 4 KB."""
    p = F.shiftrightunsigned("hash", 64 - MAP_BITS) + 1
    blocks = hashes.select(F.bitmap_bucket_number(p).alias("b"), F.bitmap_bit_position(p).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for b, m in blocks.collect():
        bits[(b - 1) * len(m) : b * len(m)] = np.frombuffer(bytes(m), np.uint8)
    return HashMap(hashes.sparkSession.sparkContext.broadcast(bits))  # one copy per executor


# Words that stand for a unit of measure after a number, in the languages of the data.
UNITS = frozenset(
    "percent prozent pourcent cent ciento процента процентов процент hours hour h min minutes minuten sek s sec ms pmol nmol mmol "
    "µl μl ml l mg µg μg g kg nm mm cm mb gb kb °c c k x units einheiten unités unidades".split()
)
# Scripts written without spaces between words: every character is a word.
_DENSE = r"\p{Han}\p{Hiragana}\p{Katakana}ー"
_WORD = regex.compile(
    rf"(?V1)\p{{N}}+(?:[.,:]\p{{N}}+)*|[{_DENSE}]|[[\p{{L}}\p{{M}}]--[{_DENSE}]][[\p{{L}}\p{{M}}\p{{N}}]--[{_DENSE}]]*(?:[-_.][[\p{{L}}\p{{N}}]--[{_DENSE}]]+)*|[%°]"
)
_IS_DENSE = regex.compile(f"[{_DENSE}]")


def template(text: str) -> tuple[list[str], list[str]]:
    """Words with numbers, units and names as typed placeholders, and the value behind each ('' for plain words).

    A name is a word that mixes letters with digits, has a capital after its first letter, or starts
    with a capital inside a sentence; the first word of a sentence is plain unless it mixes or is
    followed by a Han or Kana character, as these scripts start no sentence with a capital. Han and
    Kana characters are a plain word each.
    """
    out, slots, end = [], [], 0
    for m in _WORD.finditer(text):
        w, between = m.group(), text[end : m.start()]
        first = end == 0 or bool(regex.search(r"[.!?。？！:\n]", between))
        end = m.end()
        low = w.lower()
        if w[0].isnumeric() and not _IS_DENSE.match(w):
            kind = "<num>"
        elif low in UNITS and out and out[-1] == "<num>":
            kind = "<unit>"
        elif not _IS_DENSE.match(w) and (any(c.isnumeric() for c in w) or any(c.isupper() for c in w[1:]) or (w[0].isupper() and (not first or _IS_DENSE.match(text, end)))):
            kind = "<name>"
        else:
            out.append(low)
            slots.append("")
            continue
        out.append(kind)
        slots.append(w)
    return out, slots


#: Words of a template window and plain words in it at least; the same where at least so many are Han or Kana characters.
SPAN, PLAIN, DENSE_SPAN, DENSE_PLAIN = 14, 6, 24, 12


def template_texts(df: DataFrame, key: str, text: str, only: HashMap | None = None) -> DataFrame:
    """(key, copy, hash, pos, span, slots) of every text with a template window: all its windows and the slots of its words.

    ``copy`` is a hash of the text, as an id may come with several; the same text of an id comes once.
    ``only``: known hashes; other windows are dropped at once.
    """

    def run(t: pa.Table) -> pa.Table:
        import xxhash

        code: dict[str, int] = {}
        texts = t[text].to_pylist()
        values: list[list[str]] = []
        codes: list[int] = []
        plain: list[int] = []  # 1: a word, 2: a character, 0: a placeholder
        for x in texts:
            words, slots = template(unicodedata.normalize("NFKC", x))
            values.append(slots)
            for w in words:
                if w not in code:
                    code[w] = xxhash.xxh64_intdigest(w)
                codes.append(code[w])
            plain += [0 if s else 2 if _IS_DENSE.match(w) else 1 for w, s in zip(words, slots, strict=True)]
        sizes = np.array([len(v) for v in values], int)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        owner, c, kind = np.repeat(np.arange(len(texts)), sizes), np.array(codes, np.uint64), np.array(plain, int)
        at, hashes, spans = [], [], []
        for span, least, which in ((SPAN, PLAIN, 1), (DENSE_SPAN, DENSE_PLAIN, 2)):
            if len(c) < span:
                continue
            n = np.concatenate([[0], np.cumsum(kind == which)])
            ok = np.nonzero((owner[span - 1 :] == owner[: len(owner) - span + 1]) & (n[span:] - n[:-span] >= least))[0]
            h = _hashes(c ^ np.uint64(span), span).view(np.int64)[ok]
            if only is not None:
                keep = only.holds(h)
                ok, h = ok[keep], h[keep]
            at.append(ok)
            hashes.append(h)
            spans.append(np.full(len(h), span))
        at, hashes, spans = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (at, hashes, spans))
        order = np.argsort(at, kind="stable")
        at, hashes, spans = at[order], hashes[order], spans[order]
        rows, first = np.unique(owner[at], return_index=True) if len(at) else (np.zeros(0, int), np.zeros(0, int))
        off = pa.array(np.append(first, len(at)), pa.int32())
        lists = [pa.ListArray.from_arrays(off, pa.array(x, k)) for x, k in ((hashes, pa.int64()), (at - starts[owner[at]] if len(at) else at, pa.int32()), (spans, pa.int32()))]
        copy = pa.array([xxhash.xxh64_intdigest(texts[r].encode("utf-8", "surrogatepass")) - (1 << 63) for r in rows], pa.int64())
        return pa.table([t[key].take(pa.array(rows, pa.int64())), copy, *lists, pa.array([values[r] for r in rows], pa.list_(pa.string()))], names=[key, "copy", "hash", "pos", "span", "slots"])

    kind = df.schema[key].dataType.simpleString()
    out = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    out = out.mapInArrow(lambda it: batches(run, it), f"{key} {kind}, copy long, hash array<long>, pos array<int>, span array<int>, slots array<string>")
    return out.dropDuplicates([key, "copy"])


def _consistent(t: pa.Table) -> pa.Table:
    """The occurrences in which every value of the item turns into one value of the document, with their slots."""
    rows, slots, changed = [], [], []
    for r, (a, b, at, spans) in enumerate(zip(*[t[c].to_pylist() for c in ("a", "b", "at", "spans")], strict=True)):
        turned: dict[str, str] = {}
        low, end = min(at), 0
        for p, n in sorted(zip(at, spans, strict=True)):
            for k in range(max(p, end), p + n):
                if b[k] and turned.setdefault(b[k], a[k - low]) != a[k - low]:
                    break
            else:
                end = max(end, p + n)
                continue
            break
        else:
            rows.append(r)
            slots.append(len(turned))
            changed.append(sum(x != y for x, y in turned.items()))
    t = t.select(["doc_id", "item_id", "windows"]).take(pa.array(rows, pa.int64()))
    return t.append_column("slots", pa.array(slots, pa.int64())).append_column("changed", pa.array(changed, pa.int64()))


def reparameterised(documents: DataFrame, items: DataFrame, least: int = 2) -> DataFrame:
    """Documents that hold a test item's wording with other values: (doc_id, item_id, windows, slots, changed).

    Numbers, units and names become typed placeholders; all windows of 14 such words, or of 24 where
    12 or more are Han or Kana characters, are joined by hash, each with every item that has it. Windows at
    one distance between their places in document and item are an occurrence; it counts if its slots are
    consistent (one value of the item always turns into the same value of the document). A pair comes
    out if its occurrences hold ``least`` windows and one of them turns a value into another; pairs with
    equal values throughout are :func:`leaks`. ``slots`` and ``changed`` (distinct values of the item) are those of the
    occurrence with most changes. Null and short texts give nothing; repeated ids count as one.
    """
    theirs = written(template_texts(items, "item_id", "item_text"), "item_windows")
    only = hash_map(theirs.select(F.explode("hash").alias("hash")))
    ours = written(template_texts(documents, "doc_id", "text", only), "document_windows")
    d = ours.select("doc_id", F.col("copy").alias("doc_copy"), F.explode(F.arrays_zip("hash", "pos")).alias("z")).select("doc_id", "doc_copy", "z.hash", F.col("z.pos").alias("doc_pos"))
    i = theirs.select("item_id", F.col("copy").alias("item_copy"), F.explode(F.arrays_zip("hash", "pos", "span")).alias("z")).select("item_id", "item_copy", "z.hash", "z.pos", "z.span")
    keys = ["doc_id", "doc_copy", "item_id", "item_copy"]
    found = d.join(i, "hash").groupBy(*keys, (F.col("doc_pos") - F.col("pos")).alias("off"))
    found = found.agg(F.collect_list(F.struct("pos", "span")).alias("z")).select(*keys, "off", F.col("z.pos").alias("at"), F.col("z.span").alias("spans"), F.size("z").cast("long").alias("windows"))
    found = found.join(theirs.select("item_id", F.col("copy").alias("item_copy"), F.col("slots").alias("b")), ["item_id", "item_copy"])
    found = found.join(ours.select("doc_id", F.col("copy").alias("doc_copy"), "slots"), ["doc_id", "doc_copy"])
    reached = F.array_max(F.zip_with("at", "spans", lambda p, n: p + n)) - F.array_min("at")
    found = found.withColumn("a", F.slice("slots", F.col("off") + F.array_min("at") + 1, reached)).drop("slots", "off")
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k, df in (("doc_id", documents), ("item_id", items))]
    kept = found.mapInArrow(lambda it: batches(_consistent, it), ", ".join([*kinds, "windows long, slots long, changed long"]))
    pairs = kept.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"), F.max(F.struct("changed", "slots")).alias("z"))
    return pairs.where((F.col("windows") >= least) & (F.col("z.changed") > 0)).select("doc_id", "item_id", "windows", "z.slots", "z.changed")
