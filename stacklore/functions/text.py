"""Text expressions. All but the NFKC step stay inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Character classes. They differ on purpose; each belongs to one operation.
CJK_NORMALIZE = r"\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
CJK_QUALITY = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}"
CJK_DISTILL = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
CJK_RATIO = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"
PRIVATE_USE = r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}"
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
SENTENCE_END = ".!?;。！？；…"


@pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


#: ASCII and the Latin letters and signs that NFKC leaves as they are, whatever of these stands beside them
NFKC_STABLE = (
    r"\x{00}-\x{9F}\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}"
)


def nfkc(s: Column, wanted: Column | None = None) -> Column:
    """NFKC form; only texts with a character that it could change (and of these only the wanted ones) leave the JVM."""
    rare = s.rlike(f"[^{NFKC_STABLE}]")
    return F.coalesce(_nfkc(F.when(rare if wanted is None else wanted & rare, s)), s)


def unify_line_ends(s: Column) -> Column:
    return F.regexp_replace(s, "\r\n|[\r\u000b\u000c\u0085\u2028\u2029]", "\n")


def strip_invisible(s: Column) -> Column:
    return F.translate(s, INVISIBLE, "")


#: dashes, ellipses and quotes that are written in more than one way
UNIFIED = "\u2e3a\u2e3b\u2015\u2011\u22ef\u201c\u201d\u2018\u2019"


def unify_punctuation(s: Column) -> Column:
    longer = F.replace(F.replace(s, F.lit("\u2e3a"), F.lit("\u2014" * 2)), F.lit("\u2e3b"), F.lit("\u2014" * 3))
    return F.translate(longer, "\u2015\u2011\u22ef\u201c\u201d\u2018\u2019", "\u2014\u2010\u2026\"\"''")


def fold_lines(s: Column) -> Column:
    """Trim spaces of every line and make runs of them one."""
    return F.regexp_replace(F.regexp_replace(s, "(?md)^ +| +$", ""), " {2,}", " ")


def join_cjk(s: Column) -> Column:
    return F.regexp_replace(s, f"(?<=[{CJK_NORMALIZE}]) (?=[{CJK_NORMALIZE}])", "")


def _once(s: Column, f) -> Column:
    """f of s, with s worked out once however often f names it."""
    return F.transform(F.array(s), f)[0]


#: words of letters and signs that no step of normalize changes, with one blank, line break or blank line between two
_PLAIN_WORD = (
    r"(?:[!-~]++|[\x{A1}-\x{A7}\x{A9}\x{AB}\x{AC}\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}]++)++"
)
PLAIN = rf"\A(?:{_PLAIN_WORD}(?:(?: |\n\n?+){_PLAIN_WORD})*+)?+\z"


def normalize(s: Column) -> Column:
    """Frozen form of a text: its hash says that two passages are the same. The order of the steps is part of it.

    Most texts are plain and stay as they are, which one look tells; only the others go through the steps.
    """
    return F.when(s.rlike(PLAIN), s).otherwise(_steps(s))


def _steps(s: Column) -> Column:
    s = nfkc(unify_line_ends(s), ~s.rlike(PLAIN))
    # translate looks every character up in a map, so only texts with something to translate go there
    rare = "".join(f"\\x{{{ord(c):x}}}" for c in INVISIBLE + UNIFIED)
    s = _once(s, lambda x: F.when(x.rlike(f"[{rare}]"), unify_punctuation(strip_invisible(x))).otherwise(x))
    s = F.replace(s, F.lit("\t"), F.lit(" "))
    s = F.regexp_replace(join_cjk(fold_lines(s)), "\n{3,}", "\n\n")
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def norm_sha256(s: Column) -> Column:
    return F.sha2(normalize(s), 256)


def sentence_count(s: Column) -> Column:
    """Runs of sentence ends; one at least where there is any content."""
    return F.when(~s.rlike(r"(?U)\S"), 0).otherwise(F.greatest(F.lit(1), F.regexp_count(s, F.lit(f"[{SENTENCE_END}]+"))))


def collapse_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def fold_fullwidth(s: Column) -> Column:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
    return F.translate(s, wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ")


def alphanumeric_core(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "")


def lookup_key(s: Column, latin: Column) -> Column:
    """Key under which an entry is found: folded for Latin headwords, trimmed otherwise."""
    return F.when(latin, alphanumeric_core(s)).otherwise(F.trim(s))


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.nullif(F.trim(F.regexp_replace(name, r"\.[^.]*$", "")), F.lit(""))


def heading_level(line: Column) -> Column:
    """1 for a volume, 2 for a chapter line, null for any other.

    Three families of rules, of which the first to match counts: an ordinal prefix with a
    numeral and a unit; a unit word with a numeral; a spelled ordinal with a unit.
    """
    # Units, numerals and spelled ordinals of heading lines, and the longest line of each family.
    numeral = "零一二三四五六七八九十百千万两壹贰叁肆伍陆柒捌玖拾０１２３４５６７８９"
    latin_number = r"(?:[IVXLCDM]{1,8}|\d+|primero|premier|primo|one|first)"
    volumes, chapters = "book|tome|livre|libro|parte|partie", "chapter|chapitre|capítulo|capitolo"
    stems = (
        "erst|zweit|dritt|viert|fünft|sechst|siebt|siebent|acht|neunt|zehnt|elft|zwölft|dreizehnt|vierzehnt|"
        "fünfzehnt|sechzehnt|siebzehnt|achtzehnt|neunzehnt|zwanzigst"
    )
    size = F.char_length(line)
    latin = lambda units: line.rlike(rf"(?iu)^(?:{units})\s+{latin_number}(?:\b|$)")
    return (
        F.when((size <= 60) & line.rlike(f"^第[{numeral}]+[卷部篇巻]"), 1)
        .when((size <= 60) & line.rlike(f"^第[{numeral}]+[章节回節話]"), 2)
        .when((size <= 100) & latin(volumes), 1)
        .when((size <= 100) & latin(chapters), 2)
        .when((size <= 30) & line.rlike(rf"(?iu)^(?:{stems})er\s+teil$"), 1)
        .when((size <= 30) & line.rlike(rf"(?iu)^(?:{stems})es\s+kapitel$"), 2)
    )


def roman_value(s: Column) -> Column:
    """Value of a canonical Roman numeral up to 30, else null."""
    tens, ones = ["", "X", "XX", "XXX"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    known = {tens[n // 10] + ones[n % 10]: n for n in range(1, 31)}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.upper(s))


def heading_number(line: Column) -> Column:
    """Parts of a numbered heading's prefix (1, 1.2, 1.2.3, or a Roman numeral), else null."""
    arabic = F.regexp_extract(line, r"^(\d{1,2}(?:\.\d{1,2}){0,2})\.?\s+\S", 1)
    roman = roman_value(F.regexp_extract(line, r"^([IVX]{1,6})\.\s+\S", 1))
    return F.when(arabic != "", F.transform(F.split(arabic, r"\."), lambda x: x.cast("int"))).when(
        roman.isNotNull(), F.array(roman)
    )


def script_ratios(s: Column) -> Column:
    """Shares of CJK (with kana and hangul) and Latin letters among characters that are not white space."""
    dense = F.greatest(F.char_length(F.regexp_replace(s, r"(?U)\s", "")), F.lit(1))
    share = lambda cls: F.regexp_count(s, F.lit(f"[{cls}]")) / dense
    return F.struct(share(CJK_RATIO).alias("cjk"), share("A-Za-z").alias("latin"))


def line_is_cjk(s: Column) -> Column:
    return F.regexp_count(s, F.lit(f"[{CJK_DISTILL}]")) > F.regexp_count(s, F.lit("[A-Za-z]"))


def body_agrees(text: Column, lang: Column) -> Column:
    """Whether the first 2048 letters fit the declared language; null for languages without a rule."""
    # Languages by script and the ratios that contradict them.
    cjk_langs = ["zh", "ja", "ko"]
    latin_langs = ["en", "fr", "de", "es", "it", "pt", "nl", "sv", "no", "da", "fi", "pl", "ru"]
    letters = F.substring(F.regexp_replace(text, r"[^\p{L}]", ""), 1, 2048)
    n = F.greatest(F.char_length(letters), F.lit(1))
    cjk = F.regexp_count(letters, F.lit(f"[{CJK_QUALITY}]")) / n
    latin = F.regexp_count(letters, F.lit("[A-Za-z]")) / n
    primary = F.lower(F.substring_index(lang, "-", 1))
    return F.when(primary.isin(cjk_langs), ~((cjk < 0.10) & (latin > 0.60))).when(primary.isin(latin_langs), cjk <= 0.40)


def is_bcp47(s: Column) -> Column:
    return s.rlike("^[A-Za-z]{2,3}(-([A-Za-z]{2}|[A-Za-z0-9]{3}|[A-Za-z]{4}))*$")


def is_placeholder(s: Column) -> Column:
    # Titles that name nothing.
    words = ["unknown", "untitled", "no title", "anonymous", "n a", "na"]
    core = F.lower(F.regexp_replace(s, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return core.isin(words)


def fold_publisher(s: Column) -> Column:
    """Lower case, no punctuation, single spaces, abbreviations written out."""
    # Abbreviations of publishers' names.
    words = {"univ": "university", "publ": "publishing", "pub": "publishing", "co": "company", "intl": "international"}
    known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    plain = collapse_space(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}\s]", " "))
    return F.array_join(F.transform(F.split(plain, " "), lambda t: F.coalesce(F.try_element_at(known, t), t)), " ")


def like_escape(needle: str) -> str:
    return needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def ascii_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def human_bytes(n: Column) -> Column:
    steps = [(1 << 40, "TiB"), (1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB")]
    out = F.concat(n.cast("string"), F.lit(" B"))
    for size, unit in reversed(steps):
        out = F.when(n >= size, F.concat(F.format_number(n / size, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def redact(s: Column) -> Column:
    """Paths, file names of books and runs of CJK characters replaced by short hashes or marks, inside the JVM.

    A name is cut out of the text, hashed, and put back with ``transform`` over the parts
    between the names, since a replacement cannot depend on its match.
    """
    for pattern, mark in (
        (r"(?i)/Users/[^/\s]+/", "<HOME>/"),
        (r"(?i)/home/[^/\s]+/", "<HOME>/"),
        (r"(?i)[A-Z]:\\Users\\[^\\\s]+\\", r"<HOME>\\\\"),
        (r"(?i)/Volumes/[^/]+/", "<VOL>/"),
    ):
        s = F.regexp_replace(s, pattern, mark)
    books = r"(?i)(?<=[/\\])[^/\\\n]+\.(?:pdf|epub|djvu|mobi|md|azw3)(?![A-Za-z0-9])"
    s = _replace_each(
        s,
        books,
        lambda m: F.concat(
            F.lit("<file:"), F.substring(F.sha2(F.regexp_replace(m, r"\.[^.]*$", ""), 256), 1, 12), F.lit(">."),
            F.element_at(F.split(m, r"\."), -1),
        ),
    )
    return _replace_each(
        s,
        f"[{CJK_RATIO}]{{2,}}",
        lambda m: F.concat(F.lit("<cjk:"), F.substring(F.sha2(m, 256), 1, 12), F.lit(">")),
    )


def _replace_each(s: Column, pattern: str, by) -> Column:
    found = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    between = F.split(s, pattern, -1)
    pairs = F.zip_with(between, F.transform(found, by), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.size(found) == 0, s).otherwise(F.array_join(pairs, ""))
