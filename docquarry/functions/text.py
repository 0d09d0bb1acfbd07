"""Text columns: trimming, tokens, titles, HTML stripping, match offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.errors import InvalidConfiguration

# The characters Python's str.strip() and str.split() treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a Java character class. The range test in front lets the matcher
# leave out the single tests for nearly every character.
SPACE_CLASS = (
    r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
# Letters, digits and underscore of any script, as a word.
WORD = r"[\p{L}\p{N}_]+"

MAX_TITLE = 99


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def squeeze(text: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.btrim(F.regexp_replace(text, f"[{SPACE_CLASS}]+", " "))


def words(text: Column) -> Column:
    """Lower-cased words of *text*, in order, duplicates kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def split_tokens(text: Column) -> Column:
    """White-space separated tokens, case kept."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE_CLASS}]+"), F.lit(0))


def spaced_tokens(text: Column) -> Column:
    """Tokens that carry their leading white space: joining them gives *text* back."""
    pattern = f"[{SPACE_CLASS}]*[^{SPACE_CLASS}]+|[{SPACE_CLASS}]+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def token_length(text: Column, model: str = "words") -> Column:
    """Number of tokens under a pluggable native token model."""
    if model == "words":
        return F.size(split_tokens(text))
    if model == "chars4":
        return F.ceil(F.length(text) / 4).cast("int")
    if model == "chars":
        return F.length(text)
    raise InvalidConfiguration("unknown token model", model=model)


def first_short_line(text: Column) -> Column:
    """First line that is non-empty after trimming and shorter than 100 characters."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.get(F.filter(lines, lambda x: F.length(x).between(1, MAX_TITLE)), F.lit(0))


def markdown_title(text: Column) -> Column:
    """First level-one heading, else the first short line."""
    heading = strip(F.regexp_extract(text, r"(?md)^\s*#\s+(.+?)$", 1))
    return F.when(F.length(heading) > 0, heading).otherwise(first_short_line(text))


def html_title(html: Column) -> Column:
    """``<title>``, else the first ``<h1>`` without inner tags, else the first short line."""
    title = F.regexp_extract(html, r"(?is)<title>(.+?)</title>", 1)
    h1 = F.regexp_extract(html, r"(?is)<h1[^>]*>(.+?)</h1>", 1)
    return (
        F.when(F.length(title) > 0, strip(title))
        .when(F.length(h1) > 0, strip(strip_tags(h1)))
        .otherwise(first_short_line(html))
    )


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


# The entities decoded when HTML becomes text; the ampersand comes last.
ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&amp;", "&"),
)
BLOCK_TAGS = "p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|aside|nav|header|footer|title"


def html_text(html: Column) -> Column:
    """Readable text of a page: no scripts, styles, comments or tags; one line per block."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, rf"(?i)</?({BLOCK_TAGS})(\s[^>]*)?/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t\r\x0b\f]+", " ")
    out = F.regexp_replace(out, r" ?\n[ \n]*", "\n")
    return F.btrim(out, F.lit(" \n"))


def match_spans(text: Column, pattern: str) -> Column:
    """All matches of *pattern* with their code-point offsets.

    The text between matches comes from ``split``; adding up the lengths gives the offsets, so no
    Python is needed. Result: ``array<struct<position:int,match:string>>``.
    """
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda match, gap: F.struct(match.alias("match"), gap.alias("gap")),
    )
    found = F.filter(pairs, lambda p: p["match"].isNotNull())
    start = F.struct(
        F.lit(0).alias("at"),
        F.expr("cast(array() as array<struct<position:int,match:string>>)").alias("spans"),
    )

    def step(acc, pair):
        position = (acc["at"] + F.length(pair["gap"])).cast("int")
        span = F.struct(position.alias("position"), pair["match"].alias("match"))
        return F.struct(
            (position + F.length(pair["match"])).cast("int").alias("at"),
            F.concat(acc["spans"], F.array(span)).alias("spans"),
        )

    return F.aggregate(found, start, step, lambda acc: acc["spans"])


def basename(path: Column) -> Column:
    """File name without folder and last extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def excerpt(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(
        text
    )


def java_glob(pattern: str) -> str:
    """Shell pattern (``*``, ``?``, ``[...]``) as a regular expression; ``*`` crosses folders."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        end = pattern.find("]", i + 2) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append("\\" + char if char in r"\.^$+{}()|[]&" else char)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(java_glob(pattern))


def path_glob_match(path: Column, pattern: str) -> Column:
    """Right-anchored match by path parts, as ``pathlib``'s relative ``match`` does."""
    parts = [java_glob(part)[5:-1].replace(".*", "[^/]*") for part in pattern.strip("/").split("/")]
    return path.rlike("(?s)(^|/)" + "/".join(parts) + "$")
