"""Per-document text quality statistics (problem 10).

A forum post is first cut down to its own text: quoted posts and the signature go. Its lines are then told apart:

* tables, from delimiters that stand vertically aligned: in the same columns as those of the lines around, or, where
  fields aren't padded, in the same order;
* lists, from marks before the first word that stand aligned in the same way (enumerations by their numbers), from an
  indentation that comes back under short lines, from runs of short lines of like length (autocorrelation of line lengths)
  written as names, both whatever their words, and from runs of short lines without the words that sentences need;
* junk, from the shares of letters, words, symbols and digits, and from repetition.

What is left is prose. All of a text is read; every pattern is linear in its length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from operator import mul

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.operators.scale import lookup

#: A document is structured if more than this share of its own characters lies in list items, table rows or junk.
STRUCTURED = 0.5
#: Words that are held in each worker; of a larger table each text is joined with those that it has.
MAX_WORDS = 100_000
#: Lines of under SHORT characters may be items without a mark; RUN of them with lengths ALIKE and NAMES of the rarer words
#: capitalised are, without an indentation.
SHORT, RUN, ALIKE, NAMES = 60, 4, 0.9, 0.9

_QUOTE = re.compile(r"\[quote[^\]\n]{0,80}\]|\[/quote\]|<blockquote[^>\n]{0,80}>|</blockquote>", re.I)
_BLANK = re.compile(r"\n[ \t\r]*\n")
_QUOTED_LINE = re.compile(r"\s*(?:>|&gt;)(?!\s*$)|\s*(?:>|&gt;)\s*$")
#: What begins a signature: the usual two dashes, a tag, a tilde before its text, or a rule of one sign.
_SIGNATURE = re.compile(r"\s*(?:--|—|\[sig\].*|(?:~\*)?~ \S.*|([_*=~-])(?: ?\1){4,})\s*$")
_TAG = re.compile(r"</?[a-z][^<>\n]{0,200}>|\[/?(?:b|i|u|s|color|url|img|size|sig|spoiler|code|list|\*|quote|font|center)(?:=[^\]\n]{0,200})?\]|&[a-z]{2,8};|&#\d{1,6};", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_URL = re.compile(r"\b(?:https?://|www\.)\S+|[\w.+-]{1,64}@\S{1,200}")
_HEAD = re.compile(r"[^\W\d_]{2}")
_SINGLE, _DIGITS, _ALNUM = re.compile(r"[^\W\d_]"), re.compile(r"\d+"), re.compile(r"\w+")
_MARKED = re.compile(r"\s*(?:<(?:/?[uod]l|li|/?t(?:able|r|d|h|body|head)|d[td])\b|\[\*\]|\[/?(?:list|table|tr|td|th)\b)", re.I)
_KANA = re.compile(r"[぀-ヿ]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_ENDERS, _CLOSERS = frozenset(".!?…。！？"), frozenset("\"'”’»)]\ufe0f")
_DELIMITERS = re.compile(r"\t|\||;|,|:| / | - | – |->|=|  +")
_SPACES = re.compile(r"\s+")

STATS = (
    "n_chars long, n_words long, mean_word_length double, symbol_ratio double, end_punctuation_share double, frequent_share double, "
    "delimiter_alignment double, indent_periodicity double, length_autocorrelation double, list_share double, table_share double, junk_share double, is_structured boolean"
)


def _ends(line: str) -> bool:
    """Whether a line ends as a sentence does, closing marks, pictographs and white space aside."""
    for c in reversed(line):
        if c in _ENDERS:
            return True
        if not (c.isspace() or c in _CLOSERS or 0x2600 <= ord(c) <= 0x27BF or 0x1F300 <= ord(c) <= 0x1FAFF):
            return False
    return False


def _attributes(lines: list[str], k: int) -> bool:
    """Whether line k names whose words follow: it ends in a colon and the next line is quoted."""
    if not lines[k].rstrip().endswith(":"):
        return False
    after = next((x.strip() for x in lines[k + 1 : k + 3] if x.strip()), "")
    return bool(_QUOTED_LINE.match(after)) or after.startswith("|") and (after == "|" or not after.endswith("|"))


def own_text(text: str) -> list[str]:
    """The lines of a post without quoted posts and signature. A quote that is never closed ends at the next blank line,
    or with the text. A signature is the last paragraph from a mark on, unless its lines stand aligned as a table's or
    list's do."""
    spans: list[tuple[int, int]] = []
    opened: list[int] = []
    for m in _QUOTE.finditer(text):
        if m.group().startswith(("[/", "</")):
            spans.append((opened.pop(), m.end()) if opened else (m.start(), m.end()))
        else:
            opened.append(m.start())
    closed: list[tuple[int, int]] = []  # closed quotes, nested ones merged
    for a, b in sorted(spans):
        closed[-1:] = [(closed[-1][0], max(b, closed[-1][1]))] if closed and a < closed[-1][1] else [*closed[-1:], (a, b)]
    blanks = [m.start() for m in _BLANK.finditer(text)] if opened else []
    for p in opened:
        if _QUOTED_LINE.match(text[text.rfind("\n", 0, p) + 1 : p]):  # it goes with its line
            continue
        at = p
        while (k := bisect_left(blanks, at)) < len(blanks):
            j = bisect_left(closed, (blanks[k], 0)) - 1
            if j < 0 or closed[j][0] < p or closed[j][1] <= blanks[k]:
                break
            at = closed[j][1]  # that blank line is inside a closed quote
        spans.append((p, blanks[k] if k < len(blanks) else len(text)))
    kept, at = [], 0
    for a, b in sorted(spans):
        if a > at:
            kept.append(text[at:a])
        at = max(at, b)
    kept.append(text[at:])
    every, lines, said = "\n".join(kept).splitlines(), [], False
    for k, line in enumerate(every):
        if _attributes(every, k):
            said = True
        elif _QUOTED_LINE.match(line) or said and line.lstrip().startswith("|"):
            pass
        else:
            said = said and not line.strip()
            lines.append(line)
    last = len(lines)
    while last and not lines[last - 1].strip():
        last -= 1
    start = last
    while start and lines[start - 1].strip():
        start -= 1
    for k in range(start, last):
        if _SIGNATURE.match(lines[k]):
            heads = [_head(x) for x in lines[k + 1 : last]]
            shapes = [_shape(x) for x in lines[k + 1 : last]]
            rows = sum(bool(h) and heads.count(h) > 2 or len(s) > 1 and shapes.count(s) > 2 for h, s in zip(heads, shapes))
            if 2 * rows <= len(heads):
                return lines[:k]
            break
    return lines


def _head(line: str) -> str:
    """The sign of a line's first mark: what stands before its first word of two letters or more, with digits as 0 and single
    letters left out, if it has a sign or number that white space or a bracket sets off; else ''. All of one list have one."""
    x = line.strip()
    m = _HEAD.search(x)
    head = x[: m.start()] if m else x[:12]
    if not head or not (head[-1].isspace() or head[-1] in ")]") or m and x.endswith(head.strip() or " "):  # the same at the end: emphasis
        return ""
    bare = head.strip()
    if len(bare) > 1 and bare == bare[::-1] and _SINGLE.search(bare):  # a single letter, emphasised
        return ""
    signs = _SPACES.sub("", _DIGITS.sub("0", _SINGLE.sub("", head)))
    return signs[:8]


def _shape(line: str) -> tuple[str, ...]:
    """The row of delimiters of a line, runs of spaces as one sign and comma and semicolon as one."""
    return tuple("," if d in ",;" else " " if d.isspace() and d != "\t" else d for d in _DELIMITERS.findall(line.strip()))


def _columns(line: str) -> frozenset[tuple[str, int]]:
    """Where the delimiters of a line stand: of gaps the end, where the next field begins, of signs the sign."""
    return frozenset((" ", m.end()) if m.group().isspace() else (m.group(), m.start()) for m in _DELIMITERS.finditer(line.rstrip()) if m.start())


def _aligned(k: int, near: list[int], shapes: list[tuple[str, ...]], columns: list[frozenset[tuple[str, int]]]) -> bool:
    """Whether two or more delimiters of line k stand vertically aligned with a line near it: all in one order, or half of
    them or more in the same columns."""
    if len(shapes[k]) < 2:
        return False
    return any(shapes[j] == shapes[k] or (c := len(columns[k] & columns[j])) >= 2 and 2 * c >= len(columns[k]) for j in near)


def _marked_alike(k: int, near: list[int], heads: list[str], lines: list[str]) -> bool:
    """Whether the mark before line k's first word comes back before a line near it; of bare numbers the next or one before."""
    if not heads[k]:
        return False
    alike = [j for j in near if heads[j] == heads[k]]
    if heads[k] != "0":
        return bool(alike)
    number = lambda j: int(_DIGITS.search(lines[j]).group()[:9])
    return any(0 < (number(j) - number(k)) * (1 if j > k else -1) <= 2 for j in alike)


def _autocorrelation(x: list[int]) -> float:
    """Correlation of neighbours; 1 for a constant row of three or more."""
    if len(x) < 3:
        return 0.0
    mean = sum(x) / len(x)
    d = [v - mean for v in x]
    v = sum(map(mul, d, d))
    return 1.0 if v < 1e-9 else sum(map(mul, d, d[1:])) / v


def _recurs(indents: list[int]) -> list[bool]:
    """Which lines repeat an indentation above 0 of the lines around them; headings at 0 may stand between."""
    return [i > 0 and (i in indents[max(0, k - 2) : k] or i in indents[k + 1 : k + 3]) for k, i in enumerate(indents)]


def _periodicity(indents: list[int]) -> float:
    """Share of lines whose indentation recurs."""
    return sum(_recurs(indents)) / len(indents) if indents else 0.0


def _alike(x: list[int]) -> bool:
    """Whether the lengths of a run of lines are alike: their autocorrelation about 0, as a cosine."""
    return sum(map(mul, x, x[1:])) >= ALIKE * (sum(map(mul, x[:-1], x[:-1])) * sum(map(mul, x[1:], x[1:]))) ** 0.5


def _listed(lines: list[str], frequent: frozenset[str]) -> set[int]:
    """Lines that structure alone makes list items, whatever their words: in a run of short lines of one block without
    the end or the comma of a sentence, two or more that share a recurring indentation and begin alike, or RUN or more
    of like length whose words outside the frequent ones are capitalised, as in names and titles. Wrapped prose begins
    in capitals and goes on in small letters."""
    filled = [k for k, x in enumerate(lines) if x.strip()]
    indents = [len(lines[k]) - len(lines[k].lstrip()) for k in filled]
    recurs = dict(zip(filled, _recurs(indents)))
    indent = dict(zip(filled, indents))
    found: set[int] = set()
    run: list[int] = []
    for k in range(len(lines) + 1):
        x = lines[k].strip() if k < len(lines) else ""
        short = x and len(x) < SHORT and not _ends(x) and x[-1] not in ",;:"
        if short and (not run or indent[k] == indent[run[-1]]):
            run.append(k)
            continue
        if len(run) >= 2:
            small = sum(lines[j].lstrip()[0].islower() for j in run)
            if all(recurs[j] for j in run):
                if small in (0, len(run)):
                    found.update(run)
            elif len(run) >= RUN and small == 0:
                rare = [w for j in run for w in _WORD.findall(lines[j]) if w.lower() not in frequent]
                if len(rare) >= len(run) and sum(w[0].isupper() for w in rare) >= NAMES * len(rare) and _alike([len(lines[j].strip()) for j in run]):
                    found.update(run)
        run = [k] if short else []
    return found


def _repetitive(line: str) -> bool:
    """Whether a long line says the same again and again."""
    if len(line) < 60:
        return False
    raw = line.encode("utf-8", "replace")
    return len(zlib.compress(raw, 1)) < 0.25 * len(raw)


def _kinds(lines: list[str], frequent: frozenset[str]) -> tuple[list[str], float]:
    """'prose', 'list', 'table', 'junk' or '' (blank) for each line; and the share of lines with aligned delimiters."""
    n = len(lines)
    plain = [(_TAG.sub("", x) if "<" in x or "[" in x or "&" in x else x).strip() for x in lines]
    words = [_WORD.findall((_URL.sub(" ", x) if "@" in x or "://" in x or "www." in x else x).lower()) for x in plain]
    common = [sum(map(frequent.__contains__, ws)) for ws in words]
    shapes = [_shape(x) for x in plain]
    columns = [_columns(x) if len(s) > 1 else frozenset() for x, s in zip(lines, shapes)]
    heads = [_head(x) for x in plain]
    kinds, aligned = [""] * n, 0
    filled = [k for k in range(n) if lines[k].strip()]
    place = {k: p for p, k in enumerate(filled)}
    listed = _listed(lines, frequent)

    def texty(k: int) -> bool:
        if not plain[k].isascii() and len(_KANA.findall(plain[k])) >= 0.2 * max(1, len(plain[k])):
            return True
        return len(words[k]) >= 3 and common[k] >= max(1, 0.15 * len(words[k]))

    for k in filled:
        x = plain[k]
        solid = "".join(x.split())
        p = place[k]
        near = [filled[q] for q in (p - 2, p - 1, p + 1, p + 2) if 0 <= q < len(filled)]
        same = _aligned(k, near, shapes, columns)
        aligned += same
        if _MARKED.match(lines[k]):
            kinds[k] = "table" if re.search(r"t[rdh]|table", lines[k][:40], re.I) else "list"
            continue
        if not solid:
            kinds[k] = "markup"
            continue
        letters = sum(map(str.isalpha, solid))
        in_words = sum(map(len, words[k]))
        is_text = texty(k)
        if _marked_alike(k, near, heads, plain) or heads[k] not in ("", "0") and len(filled) == 1:
            kinds[k] = "list"
        elif same and not is_text:
            kinds[k] = "table"
        elif set(solid) <= set("-+|=_:*~#.") and len(solid) >= 3:
            kinds[k] = "rule"
        elif k in listed and letters >= 0.6 * len(solid):
            kinds[k] = "list"
        elif is_text and in_words >= 0.8 * len(solid):
            kinds[k] = "prose"
        elif _repetitive(x):
            kinds[k] = "junk"
        elif is_text:
            kinds[k] = "prose"
        elif len(solid) >= 12 and (letters < 0.6 * len(solid) or in_words < 0.5 * len(solid)):
            kinds[k] = "junk"
        elif max(map(len, x.split())) >= 40 and not _CJK.search(x):
            kinds[k] = "junk"
        elif len(words[k]) >= 12 and common[k] < 0.06 * len(words[k]) and not _CJK.search(x):  # a sentence this long has frequent words
            kinds[k] = "list" if len(re.findall(r"[,;|/•·]", x)) >= len(words[k]) / 5 else "junk"
        else:
            kinds[k] = "?"
    return kinds, aligned / len(filled) if filled else 0.0


def _settle(lines: list[str], kinds: list[str]) -> list[str]:
    """Decides the lines that no mark of their own decides, by the block (between blank lines) that they stand in: next to
    prose they are wrapped prose; in a run of three or more short lines without sentence ends, or
    five or more that have no line of prose among them, they are list items."""
    kinds = kinds[:]
    block: list[int] = []
    for k in range(len(lines) + 1):
        if k < len(lines) and kinds[k]:
            block.append(k)
            continue
        open_ = [j for j in block if kinds[j] == "?"]
        if open_:
            count = {t: sum(len(lines[j].strip()) for j in block if kinds[j] == t) for t in ("prose", "list", "table", "junk")}
            size = sum(len(lines[j].strip()) for j in open_)
            ended = sum(_ends(lines[j]) for j in open_)
            run = len(open_) >= 3 and size < 60 * len(open_)
            if count["prose"] >= 0.5 * size:
                kind = "prose"
            elif max(count["list"], count["table"], count["junk"]) > 0 and len(block) > len(open_):
                kind = max(("list", "table", "junk"), key=count.get)
            elif run and (ended < 0.34 * len(open_) or len(open_) >= 5 and len(open_) == len(block)):
                kind = "list"
            else:
                kind = "prose"
            for j in open_:
                kinds[j] = kind
        others = Counter(kinds[i] for i in block if kinds[i] not in ("rule", "markup"))
        for j in block:
            if kinds[j] in ("rule", "markup"):
                kinds[j] = others.most_common(1)[0][0] if others else "junk" if kinds[j] == "rule" and len(lines[j].strip()) > 3 else "prose"
        block = []
    return kinds


def document_stats(text: str | None, frequent: frozenset[str]) -> tuple:
    """The columns of STATS. A null text has 0 characters and words and null ratios; a text without words, letters or
    own lines has the ratios that aren't defined null. Neither is structured. Characters are code points; the first six
    statistics are of the whole text, the others of its own."""
    if text is None:
        return (0, 0, None, None, None, None, None, None, None, None, None, None, False)
    words = _WORD.findall(text)
    solid = "".join(text.split())
    filled = [x for x in text.splitlines() if x.strip()]
    symbols = len(_ALNUM.sub("", solid)) + solid.count("_")
    lower = map(str.lower, words)
    part = lambda a, b: round(a / b, 6) if b else None
    head = (
        len(text), len(words), part(sum(map(len, words)), len(words)), part(symbols, len(solid)),
        part(sum(_ends(x) for x in filled), len(filled)), part(sum(map(frequent.__contains__, lower)), len(words)),
    )
    lines = own_text(text)
    own = [x for x in lines if x.strip()]
    if not own:
        return (*head, None, None, None, None, None, None, False)
    kinds, aligned = _kinds(lines, frequent)
    kinds = _settle(lines, kinds)
    size = {t: sum(len(x.strip()) for x, kind in zip(lines, kinds) if kind == t) for t in ("prose", "list", "table", "junk")}
    total = max(1, sum(size.values()))
    indents = [len(x) - len(x.lstrip()) for x in own]
    shares = tuple(round(size[t] / total, 6) for t in ("list", "table", "junk"))
    structured = size["list"] + size["table"] + size["junk"] > STRUCTURED * total
    return (*head, round(aligned, 6), round(_periodicity(indents), 6), round(_autocorrelation([len(x) for x in own]), 6), *shares, structured)


def _known_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(text, known): for each text of texts the frequent words that it has, by a join."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [(h, w) for h, t in zip(b["h"], b["t"]) for w in sorted(set(_WORD.findall(t.lower())))]
            yield pd.DataFrame(pairs, columns=["h", "word"])

    found = lookup(texts.select("h", "t").where("t is not null").distinct().mapInPandas(split, "h string, word string"), words, ["word"], "left_semi")
    return texts.join(found.groupBy("h").agg(F.collect_list("word").alias("known")), "h", "left")


def text_stats(documents: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, *STATS), one row for each row of documents. words has a column ``word`` of frequent words in lower case. Up to
    MAX_WORDS distinct ones are held by the workers: then it is a row-wise Arrow map without a shuffle. Of more, each text
    is first joined with those that it has. Other columns of documents aren't read."""
    words = words.select("word").where("word is not null").distinct()
    rows = words.limit(MAX_WORDS + 1).collect()
    frequent = frozenset(r["word"] for r in rows) if len(rows) <= MAX_WORDS else None
    names = [c.split()[0] for c in STATS.split(", ")]
    kinds = {"long": "int64", "double": "float64", "boolean": "bool"}
    types = {c.split()[0]: kinds[c.split()[1]] for c in STATS.split(", ")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = [frequent] * len(b) if frequent is not None else [frozenset(() if k is None else k) for k in b["known"]]
            out = pd.DataFrame([document_stats(t, k) for t, k in zip(b["t"], known)], columns=names, index=b.index)
            out.insert(0, key, b["k"])
            yield out.astype(types)

    x = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    if frequent is None:
        x = _known_words(x.withColumn("h", F.sha2("t", 256)), words).select("k", "t", "known")
    return x.mapInPandas(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, {STATS}")


def structured_documents(documents: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id) of the structured documents."""
    return text_stats(documents, words).where("is_structured").select("doc_id")
