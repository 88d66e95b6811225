"""Noise in text from scanned pages.

Page furniture (running headers, page numbers) is found by lines that interrupt the wrapping and recur in other paragraphs, and by its
form; words broken at line ends are joined; words with misread characters are found against a frequency lexicon of the whole
corpus: a symmetric-delete index gives candidates, an edit distance in which only confusable characters are cheap
weighs them, and counts of word pairs choose among them. Texts are read once; what they hold is written as words and
marks, and lexicon, word pairs and findings are aggregates over that.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise

#: What is read for what. A reading costs CONFUSED, whichever way the lengths differ.
CONFUSIONS = {
    "0": "o", "1": "li", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "gq",
    "c": "eo", "e": "c", "o": "ea", "a": "o", "l": "it", "i": "l", "t": "l", "q": "g", "g": "q", "h": "b", "b": "h", "u": "n", "n": "u", "f": "t", "y": "v", "v": "y",
    "†": "t", "‡": "t", "ɑ": "a", "|": "li", "$": "s", "@": "a", "€": "e", "!": "li", "ı": "i", "ο": "o", "е": "e", "а": "a", "о": "o", "с": "c",
    "rn": "m", "m": "rn", "vv": "w", "w": "vv", "cl": "d", "d": "cl", "li": "h", "h": "li", "ii": "u", "u": "ii", "ri": "n", "in": "m", "m": "in", "nn": "m",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl",
}
CONFUSED, MOST = 0.4, 1.3
#: What any other edit costs: more than MOST, so a word that needs one isn't taken for a misreading.
EDIT = 1.5
#: Readings of several characters, as pairs; those of single characters as pairs too.
READINGS = sorted({(w, r) for w, rs in CONFUSIONS.items() for r in ([rs] if len(w) > 1 or w in "ﬀﬁﬂﬃﬄ" else list(rs))} | {("m", "rn"), ("w", "vv"), ("d", "cl"), ("h", "li"), ("u", "ii"), ("m", "in")})
#: A lexicon word has so many occurrences, and a misread form of it at most one in RATIO as many.
LEXICON_COUNT, RATIO = 8, 12
#: The most frequent words, which are passed over at once: a fixed bound on what is broadcast; the others are joined.
KNOWN_WORDS = 30_000
#: Paragraphs in which a line that interrupts the wrapping recurs, digits aside, if it is a running header.
RECURS = 3

#: Signs that are read for letters inside words; the daggers at a word's end too.
_SIGNS = "†‡|$@€!"
_WORD = re.compile(rf"[^\W_]+(?:[{_SIGNS}]+[^\W_]+)*[†‡]?|[{_SIGNS}](?=[^\W\d_])[^\W_]+[†‡]?")
_ROMAN = r"(?:x{0,3}(?:ix|iv|v?i{0,3})|x[lc]v?i{0,3})"
_NUMBER = r"\d{1,4}"
#: A page number that stands alone on a line, and one that stands out within a line.
_PAGE_LINE = re.compile(rf"(?i:[-—–\[(|]?\s*(?:pp?\.\s*|page\s+|S-)?(?:{_NUMBER}|(?=[ivxlc]){_ROMAN})(?:\s*(?:of|/)\s*{_NUMBER})?\s*[-—–\])|]?)")
_PAGE = rf"(?:[—–] {_NUMBER} [—–]|(?<= )- {_NUMBER} -(?= |$)|\[{_NUMBER}\]|(?i:\bpage {_NUMBER} of {_NUMBER}\b)|\bp\. {_NUMBER}\b(?!\.\d)|(?<![\w-])S-{_NUMBER}\b(?!-))"
_NAME = r"(?:[A-Z][a-z]+|[A-Z]{3,})"
_HEAD_FORMS = (
    rf"{_NAME} (?:and|AND|&) {_NAME} (?:et al\.|ET AL\.)",
    rf"{_NAME} (?:and|AND) {_NAME}(?: [a-z]+){{1,3}} notes\b",
    r"[A-Z]{3,} AND [A-Z]{3,}(?: [A-Z]+){1,3} NOTES\b",
    r"(?:Annals|Journal|Proceedings|Transactions|Archives|Reports|Bulletin) of(?: [a-z-]+){1,5} (?:vol|no)\. \d+",
    r"(?:ANNALS|JOURNAL|PROCEEDINGS|TRANSACTIONS|ARCHIVES|REPORTS|BULLETIN) OF(?: [A-Z-]+){1,5} (?:VOL|NO)\. \d+",
    r"Chapter \d+ The [a-z-]+ [a-z-]+",
    r"CHAPTER \d+ THE [A-Z-]+ [A-Z-]+",
    r"(?i:draft) [A-Z0-9-]+ (?i:do not (?:circulate|cite|distribute))",
    rf"{_NAME}(?: \S+){{1,5}} (?:\.\.\.|…)(?=\s|$)",
)
_HEAD = "(?:" + "|".join(_HEAD_FORMS) + ")"
_PAGE_IN = re.compile(_PAGE)
_HEAD_IN = re.compile(_HEAD)
_BREAK = re.compile(r"(?<=[^\W\d_])([-¬\u00ad])[ \t]*(\r?\n|[ \t])[ \t]*(?=[^\W\d_])|(?<=\w)([¬\u00ad])(?=\w)")
_CONJUNCTIONS = {"and", "or", "to", "und", "et", "y", "e", "en", "o", "ou", "nor"}
_TITLE_LINE = re.compile(r"[A-Z][^.!?;:()\[\]]*")


@lru_cache(4096)
def _header_line(line: str) -> bool:
    return bool(_HEAD_IN.fullmatch(line))


def line_key(line: str) -> str:
    """A line as it recurs on other pages: without numbers, case and spacing."""
    return " ".join(re.sub(r"\d+", "#", line.casefold()).split())


def short_lines(text: str) -> list[str]:
    """Keys of the lines that interrupt a wrapped text: two to ten words on a line that had room for more, without a stop at its end."""
    lines = text.splitlines()
    if len(lines) < 3:
        return []
    widths = sorted(len(x) for x in lines[:-1])
    room = 0.8 * widths[len(widths) // 2]
    out = set()
    for line, after in zip(lines, lines[1:], strict=False):
        n = len(line.split())
        if 2 <= n <= 10 and len(line) + 1 + len(after.split(" ", 1)[0]) < room and line.rstrip()[-1:] not in ".!?;:,-¬\u00ad":
            out.add(line_key(line))
    return sorted(out)


def _furniture_lines(text: str, recurring: frozenset[str]) -> tuple[str, bool, bool]:
    """The text without lines that are page furniture; whether headers and page numbers were among them."""
    lines = text.splitlines()
    if len(lines) < 2:
        return text, False, False
    header = page = False
    kept, widths = [], sorted(len(x) for x in lines[:-1])
    width = widths[len(widths) // 2]
    for i, line in enumerate(lines):
        parts = [p for p in re.split(r"\s{2,}|\t", line.strip()) if p]
        pages = [bool(_PAGE_LINE.fullmatch(p)) for p in parts]
        heads = [_header_line(p) for p in parts]
        if parts and all(a or b for a, b in zip(pages, heads, strict=True)):
            page |= any(a and not b for a, b in zip(pages, heads, strict=True))
            header |= any(heads)
            continue
        if recurring and line_key(line) in recurring:
            header = True
            page |= any(pages)
            continue
        after = lines[i + 1].split(" ", 1)[0] if i + 1 < len(lines) else ""
        words = parts[0].split() if parts else []
        if (
            0 < i < len(lines) - 1 and parts and len(parts) <= 2 and 2 <= len(words) <= 8 and len(line) + 1 + len(after) < 0.8 * width
            and _TITLE_LINE.fullmatch(parts[0]) and not re.search(r"[-¬\u00ad]$|\d", parts[0])
            and lines[i - 1].rstrip()[-1:].isalpha() and lines[i + 1][:1].islower() and sum(w[0].isupper() for w in words) * 2 > len(words)
        ):
            header = True
            page |= len(parts) == 2 and pages[1]
            continue
        kept.append(line)
    return "\n".join(kept), header, page


def clean(text: str, recurring: frozenset[str] = frozenset()) -> tuple[str, bool, bool]:
    """The text without page furniture; whether a running header and a page number stood in it. ``recurring`` are keys of lines that are headers."""
    text, header, page = _furniture_lines(text, recurring)

    def cut(m: re.Match) -> str:
        nonlocal header
        header = True
        return " \x00 "

    text = _HEAD_IN.sub(cut, text)
    if header:  # a number beside a header
        text, n = re.subn(rf"(?:(?<=\x00)\s{{2,}}(?i:{_NUMBER}|(?=[ivxlc]{{2}}){_ROMAN})(?=\s|$))", " \x00 ", text)
        page |= n > 0
    text, n = _PAGE_IN.subn(" \x00 ", text)
    return re.sub(r"[ \t]*(?:\x00[ \t]*)+", lambda m: " " if m.start() else "", text), header, page or n > 0


def breaks(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, left, right, kind) of what may be words broken at a line's end: ``sure`` by its mark, ``likely``, or
    ``open`` if the next word is one that suspended hyphens stand before."""
    out = []
    for m in _BREAK.finditer(text):
        left = re.search(r"[^\W_]*$", text[: m.start()])[0]
        right = re.match(r"[^\W_]*", text[m.end() :])[0]
        if (m[1] or m[3]) != "-":
            out.append((m.start(), m.end(), left, right, "sure"))
        elif right[:1].islower() or (left.isupper() and len(left) > 1 and right.isupper()):
            out.append((m.start(), m.end(), left, right, "open" if right.lower() in _CONJUNCTIONS else "likely"))
    return out


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def plausible(word: str) -> bool:
    """Whether a token may be a misread word rather than a code, a number or a name."""
    digits = sum(c.isdigit() for c in word)
    upper = sum(c.isupper() for c in word)
    return len(word) >= 2 and digits <= 2 and digits < len(word) - 1 and (upper == 0 or (upper == 1 and word[0].isupper()) or (upper + digits == len(word) and upper >= 3))


def reading_cost(seen: str, word: str, most: float = MOST) -> float | None:
    """The weighted edit distance of reading ``word`` as ``seen``: CONFUSED for a confusion, EDIT for any other edit; None beyond ``most``, or for equal words."""
    best = {(0, 0): 0.0}

    def reach(i: int, j: int, c: float) -> None:
        if c <= most and c < best.get((i, j), most + 1):
            best[i, j] = c

    for i in range(len(seen) + 1):
        for j in range(len(word) + 1):
            c = best.get((i, j))
            if c is None:
                continue
            if i < len(seen) and j < len(word) and seen[i] == word[j]:
                reach(i + 1, j + 1, c)
            for a, b in READINGS:
                if seen.startswith(a, i) and word.startswith(b, j):
                    reach(i + len(a), j + len(b), c + CONFUSED)
            if c + EDIT <= most:
                for di, dj in ((1, 1), (1, 0), (0, 1)):
                    if i + di <= len(seen) and j + dj <= len(word):
                        reach(i + di, j + dj, c + EDIT)
    c = best.get((len(seen), len(word)))
    return c if c else None


def deletes(word: str, most: int = 2) -> set[str]:
    out = {word}
    for k in range(1, min(most, len(word) - 1) + 1):
        out |= {"".join(c for i, c in enumerate(word) if i not in gone) for gone in combinations(range(len(word)), k)}
    return out


def _joined(text: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with broken words joined, and (left, right, kind) of each possible joint."""
    found = breaks(text)
    for s, e, _, _, kind in reversed(found):
        if kind != "open":
            text = text[:s] + text[e:]
    return text, [f[2:] for f in found]


def recurring_lines(paragraphs: DataFrame) -> DataFrame:
    """(paragraph_id, recurring array): for each paragraph its lines that interrupt the wrapping there and in RECURS paragraphs or more of its package."""

    def run(batches):
        for batch in batches:
            rows = [(i, k) for i, t in enumerate(batch.column("text").to_pylist()) for k in short_lines(t)]
            if rows:
                at, keys = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in ("paragraph_id", "package_root")] + [pa.array(keys)], ["paragraph_id", "package_root", "line"])

    kept = paragraphs.where("paragraph_id is not null and text is not null").select("paragraph_id", "package_root", "text")
    lines = kept.mapInArrow(run, "paragraph_id string, package_root string, line string").distinct()
    often = lines.groupBy("package_root", "line").agg(F.count("*").alias("n")).where(F.col("n") >= RECURS).select("package_root", "line")
    return lines.where("package_root is not null").join(often, ["package_root", "line"]).groupBy("paragraph_id").agg(F.collect_set("line").alias("recurring"))  # bounded by a paragraph's lines


def read(paragraphs: DataFrame, recurring: DataFrame) -> DataFrame:
    """(paragraph_id, header, page, joints, words, plausible, hyphened) of each paragraph with a text, furniture removed and broken words joined.

    ``words`` are in lower case, ``plausible`` says of each whether it may be a misread one; ``joints`` are (left, right, kind), ``hyphened`` hyphened words.
    """

    def run(batches):
        joint = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string()), ("kind", pa.string())]))
        kinds = (pa.string(), pa.bool_(), pa.bool_(), joint, pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.string()))
        for batch in batches:
            rows = []
            for pid, t, lines in zip(*(batch.column(c).to_pylist() for c in ("paragraph_id", "text", "recurring")), strict=True):
                bare, header, page = clean(t, frozenset(lines or ()))
                text, joints = _joined(bare)
                found = words(text)
                rows.append((
                    pid, header, page, [{"left": a.lower(), "right": b.lower(), "kind": k} for a, b, k in joints],
                    [w.lower() for w in found], [plausible(w) for w in found], re.findall(r"[^\W\d_]{2,}-[^\W\d_]{2,}", bare.lower()),
                ))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["paragraph_id", "header", "page", "joints", "words", "plausible", "hyphened"])

    shape = "paragraph_id string, header boolean, page boolean, joints array<struct<left:string,right:string,kind:string>>, words array<string>, plausible array<boolean>, hyphened array<string>"
    texts = paragraphs.where("text is not null").join(recurring, "paragraph_id", "left").select("paragraph_id", "text", "recurring")
    return texts.mapInArrow(run, shape)


def word_counts(content: DataFrame) -> DataFrame:
    """(word, n) over all paragraphs; and (left-right, n) of hyphened words."""
    return content.select(F.explode("words").alias("word")).union(content.select(F.explode("hyphened"))).groupBy("word").agg(F.count("*").alias("n"))


def corrections(counts: DataFrame) -> DataFrame:
    """(word, repair, cost, n): the frequent words that each rarer word may be a misreading of.

    Both sides are indexed under what is left after deleting up to two characters and joined on it.
    """
    spark = counts.sparkSession

    def variants(batches):
        for batch in batches:
            ws, ns = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            rows = [(d, w, n) for w, n in zip(ws, ns, strict=True) if plausible(w) for d in deletes(w)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["rest", "word", "n"])

    shape = "rest string, word string, n bigint"
    lexicon = counts.where(F.col("word").rlike(r"^\p{L}{2,24}$") & (F.col("n") >= LEXICON_COUNT))
    seen = counts.where(F.length("word").between(2, 26) & ~F.col("word").contains("-"))
    a = seen.repartition(spark.sparkContext.defaultParallelism).mapInArrow(variants, shape)
    b = lexicon.mapInArrow(variants, shape).toDF("rest", "repair", "m")
    pairs = a.join(b, "rest").where(F.col("m") >= RATIO * F.col("n")).groupBy("word", "repair").agg(F.max("n").alias("seen"), F.max("m").alias("n"))

    def cost(batches):
        for batch in batches:
            c = [reading_cost(s, w) for s, w in zip(batch.column("word").to_pylist(), batch.column("repair").to_pylist(), strict=True)]
            at = [i for i, x in enumerate(c) if x is not None]
            if at:
                out = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([out.column("word"), out.column("repair"), pa.array([c[i] for i in at]), out.column("n")], ["word", "repair", "cost", "n"])

    return pairs.mapInArrow(cost, "word string, repair string, cost double, n bigint")


def _places(content: DataFrame) -> DataFrame:
    """(paragraph_id, word, before, after, plausible) of every word; no neighbour is an empty word."""
    n, none = F.greatest(F.size("words") - 1, F.lit(0)), F.array(F.lit(""))
    shifted = content.select(
        "paragraph_id", F.col("words").alias("word"), F.concat(none, F.slice("words", F.lit(1), n)).alias("before"), F.concat(F.slice("words", F.lit(2), n), none).alias("after"), "plausible"
    )
    return shifted.where(F.size("word") > 0).select("paragraph_id", F.explode(F.arrays_zip("word", "before", "after", "plausible")).alias("p")).select("paragraph_id", "p.*")


def _known(counts: DataFrame, fixes: DataFrame) -> DataFrame:
    """The most frequent words that aren't misreadings, at most KNOWN_WORDS."""
    top = counts.where(F.col("n") >= LEXICON_COUNT).join(fixes.select("word").distinct(), "word", "left_anti")
    return top.orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).select("word")


def _own_hyphens(found: DataFrame, counts: DataFrame, fixes: DataFrame) -> DataFrame:
    """(a, b, broken) of the possible breaks: broken unless the hyphened word is more usual than the joined one, or only the parts are words."""
    pairs = found.where("kind <> 'sure'").select("a", "b").distinct()
    word = counts.select("word", "n")
    n = lambda c, name: word.toDF(c, name)
    out = pairs.withColumn("whole", F.concat("a", "b")).withColumn("hyphened", F.concat_ws("-", "a", "b"))
    fix = fixes.groupBy(F.col("word").alias("whole")).agg(F.max("n").alias("n_fix"))
    out = out.join(n("whole", "n_whole"), "whole", "left").join(fix, "whole", "left").join(n("hyphened", "n_hyphened"), "hyphened", "left")
    out = out.join(n("a", "n_a"), "a", "left").join(n("b", "n_b"), "b", "left")
    zero = F.lit(0)
    whole = F.greatest(F.coalesce("n_whole", zero), F.coalesce("n_fix", zero))
    parts = (F.coalesce("n_a", zero) >= LEXICON_COUNT) & (F.coalesce("n_b", zero) >= LEXICON_COUNT) & (F.length("a") > 2) & (F.length("b") > 2)
    unusual = F.coalesce("n_hyphened", zero) > whole
    return out.select("a", "b", (~(unusual | (parts & (whole < LEXICON_COUNT)))).alias("broken"))


class Lexicon:
    """Contents, counts and corrections of a corpus, each computed over all its paragraphs and written once."""

    def __init__(self, paragraphs: DataFrame):
        self.paragraphs = paragraphs
        self.recurring = materialise(recurring_lines(paragraphs), "lines")
        self.content = materialise(read(paragraphs, self.recurring), "content")
        self.counts = materialise(word_counts(self.content), "words")
        self.fixes = materialise(corrections(self.counts), "fixes")
        known = F.broadcast(_known(self.counts, self.fixes))
        fixable = self.fixes.select("word").distinct()
        rare = _places(self.content).where("plausible and paragraph_id is not null").join(known, "word", "left_anti").join(fixable, "word", "left_semi")
        self.places = materialise(rare.select("paragraph_id", "word", "before", "after").distinct(), "places")
        self.breaks = self.content.where("paragraph_id is not null").select("paragraph_id", F.explode("joints").alias("j")).select("paragraph_id", F.col("j.left").alias("a"), F.col("j.right").alias("b"), "j.kind")
        self.hyphens = materialise(_own_hyphens(self.breaks, self.counts, self.fixes), "hyphens")
        self.repairs = materialise(repairs(self), "repairs")


def defects(paragraphs: DataFrame) -> DataFrame:
    """(paragraph_id, defect): the kinds of scan noise in each paragraph: hyphenation, misread, running_header, page_number.

    ``paragraphs`` has (paragraph_id, package_root, text). Null ids and texts have none; rows that repeat an id count once; other columns are ignored.
    """
    lex = Lexicon(paragraphs.select("paragraph_id", "package_root", "text"))
    of = lambda rows, name: rows.select("paragraph_id", F.lit(name).alias("defect"))
    own = lex.content.where("paragraph_id is not null")
    out = of(own.where("header"), "running_header").unionByName(of(own.where("page"), "page_number"))
    out = out.unionByName(of(lex.breaks.where("kind = 'sure'"), "hyphenation"))
    out = out.unionByName(of(lex.breaks.where("kind <> 'sure'").join(lex.hyphens.where("broken"), ["a", "b"], "left_semi"), "hyphenation"))
    return out.unionByName(of(lex.places.join(lex.repairs, ["word", "before", "after"], "left_semi"), "misread")).distinct()


def repairs(lex: Lexicon) -> DataFrame:
    """(word, before, after, repair): for each misread word in its context the repair with the most usual neighbours.

    Candidates are ordered by the number of word pairs they form with the neighbours in the corpus, then by cost, frequency and spelling.
    All words count as neighbours; only the pairs that are asked for are counted.
    """
    options = materialise(lex.places.select("word", "before", "after").distinct().join(lex.fixes.withColumnRenamed("n", "m"), "word"), "options")
    asked = options.select(F.col("before").alias("a"), F.col("repair").alias("b")).union(options.select("repair", "after")).where("a <> '' and b <> ''").distinct()
    asked = materialise(asked, "asked")
    pairs = _places(lex.content).select(F.col("word").alias("a"), F.col("after").alias("b")).join(asked, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = materialise(pairs, "pairs")
    scored = options.join(pairs.toDF("before", "repair", "n1"), ["before", "repair"], "left").join(pairs.toDF("repair", "after", "n2"), ["repair", "after"], "left")
    score = F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))
    best = F.max_by("repair", F.struct(score, -F.col("cost"), "m", "repair"))
    return scored.groupBy("word", "before", "after").agg(best.alias("repair"))


def repaired(paragraphs: DataFrame) -> DataFrame:
    """(paragraph_id, text, n_repairs): continuous text without page furniture, broken words joined, misread words replaced."""
    lex = Lexicon(paragraphs.select("paragraph_id", "package_root", "text"))
    fixed = lex.places.join(lex.repairs, ["word", "before", "after"]).select("paragraph_id", "word", "repair")
    own = lex.breaks.where("kind <> 'sure'").join(lex.hyphens.where("not broken"), ["a", "b"]).select("paragraph_id", F.concat("a", F.lit("-"), "b").alias("word"), F.lit("").alias("repair"))
    todo = fixed.unionByName(own).groupBy("paragraph_id").agg(F.collect_set(F.struct("word", "repair")).alias("todo"))  # bounded by a paragraph's words
    texts = lex.paragraphs.where("paragraph_id is not null and text is not null").groupBy("paragraph_id").agg(F.max("text").alias("text")).join(lex.recurring, "paragraph_id", "left")

    def run(batches):
        for batch in batches:
            rows = []
            for pid, t, lines, todo in zip(*(batch.column(c).to_pylist() for c in ("paragraph_id", "text", "recurring", "todo")), strict=True):
                fix = {x["word"]: x["repair"] for x in todo or []}
                text, header, page = clean(t, frozenset(lines or ()))
                n = header + page
                for s, e, left, right, kind in reversed(breaks(text)):
                    own = f"{left}-{right}".lower() in fix
                    if own and kind == "open":
                        continue
                    n += not own
                    text = text[:s] + ("-" if own else "") + text[e:]

                def put(m: re.Match, fix=fix) -> str:
                    nonlocal n
                    new = fix.get(m[0].lower())
                    if not new:
                        return m[0]
                    n += 1
                    return new.upper() if m[0].isupper() and len(m[0]) > 1 else new.capitalize() if m[0][0].isupper() else new

                text = re.sub(r"\s+", " ", _WORD.sub(put, text)).strip()
                rows.append((pid, text, n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["paragraph_id", "text", "n_repairs"])

    return texts.join(todo, "paragraph_id", "left").select("paragraph_id", "text", "recurring", "todo").mapInArrow(run, "paragraph_id string, text string, n_repairs bigint")
