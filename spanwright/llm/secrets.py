"""Secret scans: three base patterns, and password guess costs of values in credential contexts.

Base spans come from fixed patterns. Beside them, a value that stands in a wider credential context (CONTEXTS: names in
prose, settings and environment files, headers, options, elements, urls) is a secret if guessing it is dear: a dynamic programme over the value finds the cheapest
segmentation into dictionary words, dates, repeats, keyboard walks, character sequences and brute-force stretches, where a
segmentation of k parts costs k! times the product of the parts' guesses. Documents are scanned whole and one by one.

The dictionary has three ranked lists: passwords that guessers try first, common English words, and the words of the corpus
itself by the number of documents that hold them outside credential values (a secret that only stands where secrets stand does
not become a word by being copied). All words of MIN_DOCS documents or more count, a word's rank being the number of words that as
many documents or more hold; any other word is costed as brute force. The dictionary stays a table: the letter strings of the distinct
values are joined to it, each value is costed with the words that it holds, and the costs are joined back to the documents.

Defined cases: a null text counts as empty and has no spans; repeated rows are scanned each for itself; an empty table gives
an empty result; further columns are ignored; values of any length are costed whole; a guessed value is left out only where base
spans cover all of it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from spanwright.llm.common import dropped, id_text, small_batches, table, written
from spanwright.llm.words import COMMON

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_NAME = r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)"
_VALUE = r"""["'`]?([^\s"'`,;<>]{6,})"""
#: Where credentials stand, group 1 the value: after a name (password: x, "db_password" => "x", SECRET_KEY_BASE=x, the token is x),
#: in a header, as an option of a command, in an element of that name, and before the host of a url.
CONTEXTS = tuple(
    re.compile(x, re.I | re.A)
    for x in (
        _NAME + r"""(?:[_-]?\w{0,24})?["'`]?\]?(?:\x20*(?::=|[:=]|=>)\x20*|\x20+is\x20+)(?:bearer\x20+)?""" + _VALUE,
        r"""(?:authorization|auth[_-]header)["']?\x20*[:=]\x20*["']?(?:(?:basic|bearer|digest|token|apikey)\x20+)?""" + _VALUE,
        r"(?<![a-z])bearer\x20+(?=\S*[0-9+/_=-])" + _VALUE,
        r"(?<!\S)--?" + _NAME + r"(?:=|\x20+)" + _VALUE,
        r"<(?:\w+:)?[\w-]{0,24}" + _NAME + r"[\w-]{0,24}>\s{0,8}([^\s<>]{6,})\s{0,8}</",
        r"[a-z][a-z0-9+.-]{1,24}://[^\s:/@]{0,64}:([^\s/@]{6,})@(?=[\w\[])",
    )
)
#: A document without any of these (lower-cased) has no assignment and no context.
HINTS = ("pass", "pwd", "secret", "token", "api", "key", "credential", "auth", "bearer", "://")
#: log10 of the guesses from which a value counts as a secret.
MIN_LOG10 = 8.0

#: Words that guessers try first, most frequent first (fixed values).
WORDS = (
    "password admin welcome login master secret token root user test guest letmein dragon monkey shadow sunshine princess football "
    "baseball superman batman freedom whatever trustno hello love ninja mustang access flower hunter soccer killer pepper ginger "
    "summer winter spring autumn orange purple yellow silver golden london paris berlin madrid google apple server default change "
    "example sample demo public private database system network temp pass key api none null true false string value your here"
).split()
#: Words of the corpus: least number of documents, lengths; counts and strings that a task holds before it hands them on.
MIN_DOCS, SHORTEST, LONGEST, HELD = 5, 3, 24, 200_000
#: Parts into which documents of one value are dealt where costs come back to them.
SALTS = 8
WORD = re.compile(r"[^\W\d_]+")


class Words:
    """Ranked words; each list ranks for itself, and a word has its best rank."""

    def __init__(self, *lists: list[str]) -> None:
        self.rank: dict[str, int] = {}
        for words in lists:
            for k, w in enumerate(words, 1):
                self.rank[w] = min(k, self.rank.get(w, k))
        self.longest = max(map(len, self.rank))

    def ranked(self, ranks: dict[str, int]) -> Words:
        """These words and further ones of given ranks."""
        out = Words.__new__(Words)
        out.rank = self.rank | {w: min(k, self.rank.get(w, k)) for w, k in ranks.items()} if ranks else self.rank
        out.longest = max(self.longest, max(map(len, ranks), default=0))
        return out


BASE = Words(WORDS, COMMON)
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301!$57", "aaeoiisst")
DATES = re.compile(r"(?:19|20)\d\d(?:([-/.]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])([-/.])(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d")


def _neighbours() -> set[tuple[str, str]]:
    """Pairs of keys side by side: on one row, or on the row below at the same or the next place."""
    near = set()
    for r, row in enumerate(ROWS):
        for i, a in enumerate(row):
            for b in row[max(0, i - 1) : i + 2] + (ROWS[r + 1][max(0, i - 1) : i + 1] if r + 1 < len(ROWS) else ""):
                near |= {(a, b), (b, a)}
    return {(a, b) for a, b in near if a != b}


NEAR = _neighbours()


def _alphabet(s: str) -> int:
    size = 26 * any("a" <= c <= "z" for c in s) + 26 * any("A" <= c <= "Z" for c in s) + 10 * any("0" <= c <= "9" for c in s)
    return max(10, size + 33 * any(not c.isalnum() and c.isascii() for c in s) + 100 * any(not c.isascii() for c in s))


def segments(value: str, words: Words = BASE) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 guesses) of every part that is cheaper than brute force may be."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    forms, get = ((low, 1), (plain, 2)) if plain != low else ((low, 1),), words.rank.get
    for i in range(n):
        for j in range(i + SHORTEST, min(n, i + words.longest) + 1):
            for form, factor in forms:
                if (rank := get(form[i:j])) is not None:
                    upper = sum(c.isupper() for c in value[i:j])
                    cased = 1 if not upper else 2 if upper in (1, j - i) else 2 ** min(upper, j - i - upper + 1) + 1
                    yield i, j, math.log10(rank * cased * factor + 1)
                if (rank := get(form[i:j][::-1])) is not None:
                    yield i, j, math.log10(rank * 2 * factor + 1)
    for i in range(n):
        if m := DATES.match(value, i):
            yield i, m.end(), math.log10(365.0 * 120 * (4 if m[1] or m[2] else 1)) if m.end() - i > 4 else math.log10(120)
    for unit in range(1, min(8, n // 2) + 1):  # repeats of a short unit
        i = 0
        while i + 2 * unit <= n:
            j = i + unit
            while j < n and value[j] == value[j - unit]:
                j += 1
            if (times := (j - i) // unit) >= 2 and unit * times >= 3:
                yield i, i + unit * times, unit * math.log10(_alphabet(value[i : i + unit])) + math.log10(times)
            i = max(i + 1, j - unit + 1)
    # keyboard walks, and sequences such as abcd or 9876: where those that hold i and i + 1 end, and the turns up to a character
    walk, line, turns = [n] * (n + 1), [n] * (n + 1), [0] * (n + 1)
    for i in range(n - 2, -1, -1):
        walk[i] = walk[i + 1] if (low[i], low[i + 1]) in NEAR else i + 1
        line[i] = line[i + 1] if i + 2 < n and ord(value[i + 2]) - ord(value[i + 1]) == ord(value[i + 1]) - ord(value[i]) else i + 2
    for k in range(2, n):
        turns[k] = turns[k - 1] + (ord(low[k]) - ord(low[k - 1]) != ord(low[k - 1]) - ord(low[k - 2]))
    for i in range(n - 2):
        if (j := walk[i]) - i >= 3:
            yield i, j, math.log10(47 * 4.6) + math.log10(j - i) + 0.5 * (turns[j - 1] - turns[i + 1])
        if (j := line[i]) - i >= 3 and abs(ord(value[i + 1]) - ord(value[i])) in (1, 2):
            yield i, j, math.log10(26 * 2 * (j - i))


def _log10_factorial(k: int) -> float:
    return math.lgamma(k + 1) / math.log(10)


def _priced(n: int, one: float, ends: dict[int, list[tuple[int, float]]], price: float) -> tuple[float, int]:
    """Cheapest sum of the parts' log10 guesses and ``price`` a part over ``n`` characters, and its number of parts (the least)."""
    part, brute = [(0.0, 0)], [(math.inf, 0)]  # the last part is a segment, or a brute-force stretch
    for e in range(1, n + 1):
        (a, k), (b, m) = part[-1], brute[-1]
        brute.append(min((a + one + price, k + 1), (b + one, m)))
        best = (math.inf, 0)
        for s, g in ends.get(e, ()):
            c, k = min(part[s], brute[s])
            best = min(best, (c + g + price, k + 1))
        part.append(best)
    return min(part[-1], brute[-1])


def _counted(n: int, one: float, ends: dict[int, list[tuple[int, float]]], most: int) -> float:
    """The programme over every number of parts up to ``most``."""
    last: dict[int, int] = {}
    for e, parts in ends.items():
        for s, _ in parts:
            last[s] = max(last.get(s, 0), e)
    leaving: dict[int, list[int]] = {}
    for s, e in last.items():
        leaving.setdefault(e, []).append(s)
    part, brute = np.full(most + 1, np.inf), np.full(most + 1, np.inf)
    part[0] = 0.0
    held = {0: part}  # rows that a later segment starts from
    for e in range(1, n + 1):
        grown = brute + one
        grown[1:] = np.minimum(grown[1:], part[:-1] + one)
        part, brute = np.full(most + 1, np.inf), grown
        for s, g in ends.get(e, ()):
            part[1:] = np.minimum(part[1:], held[s][:-1] + g)
        for s in leaving.get(e, ()):
            del held[s]
        if e in last:
            held[e] = np.minimum(part, brute)
    return float(min(g + _log10_factorial(k) for k, g in enumerate(np.minimum(part, brute).tolist())))


@lru_cache(maxsize=4096)
def log10_guesses(value: str, words: Words = BASE) -> float:
    """Cost of the cheapest segmentation: log10 of k! times the parts' guesses, k the number of parts.

    With a fixed price a part the programme needs no part counts, and its optimum bounds every segmentation from below: one of k
    parts costs log10(k!) - price * k more than it at least. The whole programme runs only over numbers of parts that no such
    bound rules out, so values of thousands of characters stay cheap.
    """
    n = len(value)
    if not n:
        return 0.0
    one = math.log10(_alphabet(value))
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, g in segments(value, words):
        ends.setdefault(j, []).append((i, g))
    lo, hi = 0.0, math.log10(n + 1)
    upper, bounds = one * n, []
    for step in range(12):
        price = (lo + hi) / 2 if step else 0.0
        total, k = _priced(n, one, ends, price)
        upper = min(upper, total - price * k + _log10_factorial(k))
        bounds.append((total, price))
        if not step and k == 1 or math.log10(k) <= price <= math.log10(k + 1):
            return upper  # the bound itself is reached
        lo, hi = (price, hi) if math.log10(k) > price else (lo, price)
    open_ = [k for k in range(1, n + 1) if all(total + _log10_factorial(k) - price * k < upper - 1e-9 for total, price in bounds)]
    return min(upper, _counted(n, one, ends, open_[-1])) if open_ else upper


def _uncovered(s: int, e: int, spans: list[tuple[int, int]]) -> bool:
    """Whether a character of [s, e) lies outside ``spans``."""
    for a, b in sorted(spans):
        if a > s:
            break
        s = max(s, b)
    return s < e


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind: the base spans, and values in contexts that these don't cover."""
    found = []
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    if hinted:
        found += [(m.start(), 0, "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, "hex", m.end(), m[0]) for m in HEX.finditer(text)]
    if hinted:
        base = [(s, e) for s, _, _, e, _ in found]
        values = {m.span(1): m[1] for pattern in CONTEXTS for m in pattern.finditer(text)}
        for (s, e), value in values.items():
            e -= len(value) - len(value.rstrip(".)]}:!?"))
            if e - s >= 6 and _uncovered(s, e, base):
                found.append((s, 3, "guess", e, text[s:e]))
    return [(kind, s, e, value) for s, _, kind, e, value in sorted(set(found))]


def scan(text: str, min_log10: float = MIN_LOG10, words: Words = BASE) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, log10 guesses) by start, then kind: assign, access, hex, guess."""
    costed = ((kind, s, e, log10_guesses(value, words)) for kind, s, e, value in candidates(text))
    return [x for x in costed if x[0] != "guess" or x[3] >= min_log10]


FOUND = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("value", StringType())]))
SPANS = "array<struct<kind:string,start:long,end:long,log10_guesses:double>>"


def _counted_words(texts: Iterator[str]) -> Iterator[dict[str, int]]:
    """Numbers of the texts that hold each word outside credential values, in parts of about HELD words."""
    count: dict[str, int] = {}
    for t in texts:
        low = t.lower()
        if any(h in low for h in HINTS):
            for pattern, k in ((ASSIGN, 2), *((x, 1) for x in CONTEXTS)):
                low = pattern.sub(lambda m, k=k: m[0][: m.start(k) - m.start()] + " " + m[0][m.end(k) - m.start() :], low)
        for w in set(WORD.findall(low)):
            if SHORTEST <= len(w) <= LONGEST:
                count[w] = count.get(w, 0) + 1
        if len(count) >= HELD:
            yield count
            count = {}
    yield count


def corpus_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, rank) of all words of ``docs`` that MIN_DOCS documents or more hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for count in _counted_words(t or "" for batch in batches for t in batch.column(0).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    words = written(texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS), "words")
    # a row for each number of documents that occurs: their sum is at most the corpus's words, so the one task below has few
    ranks = words.groupBy("n").count().select("n", F.sum("count").over(Window.orderBy(F.desc("n"))).alias("rank"))
    return words.join(ranks, "n").select("word", "rank")


def strings(value: str) -> Iterator[str]:
    """What the programme may look up in the dictionary: strings of letters within the value, its plain form, and both backwards."""
    low = value.lower()
    for form in {low, low.translate(LEET)}:
        for run in WORD.finditer(form):
            letters = run[0]
            for i in range(len(letters)):
                for j in range(i + SHORTEST, min(len(letters), i + LONGEST) + 1):
                    yield letters[i:j]
                    yield letters[i:j][::-1]


def _costs(values: DataFrame, words: DataFrame) -> DataFrame:
    """(value, log10_guesses) of distinct values, each costed with the dictionary's words that it holds."""
    values = written(values.withColumn("vid", F.monotonically_increasing_id()), "values")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: set[tuple[int, str]] = set()
            for vid, value in zip(b.column("vid").to_pylist(), b.column("value").to_pylist(), strict=True):
                for x in strings(value):
                    held.add((vid, x))
                    if len(held) >= HELD:
                        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([w for _, w in held], pa.string())], names=["vid", "word"])
                        held = set()
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([w for _, w in held], pa.string())], names=["vid", "word"])

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [{x["word"]: x["rank"] for x in w or []} for w in b.column("words").to_pylist()]
            got = [log10_guesses.__wrapped__(v, BASE.ranked(w)) for v, w in zip(b.column("value").to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("value"), pa.array(got, pa.float64())], names=["value", "log10_guesses"])

    hits = values.mapInArrow(split, "vid long, word string").join(words, "word").groupBy("vid").agg(F.collect_set(F.struct("word", "rank")).alias("words"))  # at most the strings of one value
    costs = written(values.join(hits, "vid", "left").select("value", "words").mapInArrow(cost, "value string, log10_guesses double"), "costs")
    dropped(values)
    return costs


def _scanned(docs: DataFrame, doc: Column, text_col: str, min_log10: float) -> DataFrame:
    """(doc, spans): ``doc`` of every row and the spans of its text."""
    small_batches(docs.sparkSession)
    schema = docs.select(doc.alias("doc")).schema["doc"].dataType
    inside = text_col in schema.names  # then the text is read from there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("doc")
            texts = own.field(text_col) if inside else b.column("text")
            got = [[dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in candidates(t or "")] for t in texts.to_pylist()]
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([own, pa.array(got, kinds)], names=["doc", "found"])

    read = docs.select(doc.alias("doc"), *([] if inside else [F.col(text_col).cast("string").alias("text")]))
    found = read.mapInArrow(run, StructType([StructField("doc", schema, False), StructField("found", FOUND)]))
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "found")
    none = F.array().cast(SPANS)
    flat = found.where(F.size("found") > 0).select("row", F.explode("found").alias("x")).select("row", "x.*")
    words = corpus_words(docs, text_col)
    costs = _costs(flat.select("value").distinct(), words)
    dropped(words)
    dealt = costs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    order = F.array_position(F.array(*map(F.lit, ("assign", "access", "hex", "guess"))), F.col("kind"))
    kept = flat.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(dealt, ["value", "salt"]).where((F.col("kind") != "guess") | (F.col("log10_guesses") >= min_log10))
    kept = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "kind", "end", "log10_guesses"))).alias("s"))  # a document's own spans
    with_spans = found.where(F.size("found") > 0).join(kept, "row", "left").select("doc", F.coalesce(F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["log10_guesses"].alias("log10_guesses"))), none).alias("spans"))
    return with_spans.unionByName(found.where(F.size("found") == 0).select("doc", none.alias("spans")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10: float = MIN_LOG10, keep_text: bool = False) -> DataFrame:
    """doc_id and the found spans (code points, end exclusive); ``keep_text`` also hands the text on."""
    read = id_text(docs, id_col, text_col)
    return _scanned(read, F.struct("doc_id", *(["text"] if keep_text else [])), "text", min_log10).select("doc.*", "spans")


def masked(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with spans, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(text: str, min_log10: float = MIN_LOG10, mark: str = "[SECRET]", words: Words = BASE) -> str:
    """The text with every found span replaced by ``mark``."""
    return masked(text, [(s, e) for _, s, e, _ in scan(text, min_log10, words)], mark)


def mask_secrets(docs: DataFrame, text_col: str = "text", min_log10: float = MIN_LOG10) -> DataFrame:
    """``docs`` with the spans of its texts masked, all columns kept; null texts become empty."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.RecordBatch.from_struct_array(b.column("doc"))
            k = rows.schema.get_field_index(text_col)
            texts = [masked(t or "", [(x["start"], x["end"]) for x in s]) for t, s in zip(rows.column(k).to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield rows.set_column(k, rows.schema.field(k), pa.array(texts, rows.schema.field(k).type))

    return _scanned(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), text_col, min_log10).mapInArrow(run, schema)


def op7_secrets(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(line(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.round(s["log10_guesses"], 2).cast("string")), ",").alias("log10_guesses"),
    )
