"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that both ends of a text lose, as characters and as a class.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{SPACES}]"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it; a column that is named again is made again."""
    return F.transform(F.array(c), f)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def to_markdown(c: Column) -> Column:
    """Paragraphs apart by one blank line; CRLF and CR are line feeds, ends are stripped."""
    parts = F.filter(F.transform(F.split(strip(unix_lines(c)), "\n{2,}"), strip), lambda p: p != "")
    return F.array_join(parts, "\n\n")


def finalize(c: Column) -> Column:
    """Unix lines, no NUL, stripped, and one line feed at the end of what is not empty."""
    body = strip(F.replace(unix_lines(c), F.lit("\0"), F.lit("")))
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def captions_to_text(captions: Column) -> Column:
    """None is '', one stands for itself, of several those that are not empty, by line."""
    some = F.filter(captions, lambda x: x.isNotNull() & (x != ""))
    return F.when(captions.isNull() | (F.size(captions) == 0), "").when(F.size(captions) == 1, F.coalesce(captions[0], F.lit(""))).otherwise(F.array_join(some, "\n"))


def keep_edges(source: Column, made: Column) -> Column:
    """`made` stripped, between the white space at the ends of `source`; a blank `made` gives `source`."""
    core = strip(made)
    return F.when(core == "", source).otherwise(F.concat(F.regexp_extract(source, f"^{SPACE}*", 0), core, F.when(strip(source) == "", "").otherwise(F.regexp_extract(source, f"{SPACE}*\\z", 0))))


def strip_reasoning(c: Column) -> Column:
    """Without <think> sections, stripped."""
    return F.coalesce(strip(F.regexp_replace(c, r"(?is)<think\b[^>]*>.*?</think>", "")), F.lit(""))


def short_and_long(c: Column) -> tuple[Column, Column]:
    """The last two sections of a ###-separated answer, each after its first colon, on one line."""
    parts = F.split(c, "###")
    tidy = lambda p: strip(F.regexp_replace(F.regexp_replace(p, r"(?s)^[^:]*:", ""), f"{SPACE}+", " "))
    return F.coalesce(tidy(F.try_element_at(parts, F.lit(-2))), F.lit("")), tidy(F.try_element_at(parts, F.lit(-1)))


def fenced(c: Column, kind: str) -> Column:
    """The body of the last fence of a kind in a text, or ''."""
    return strip(F.regexp_extract(c, rf"(?s)^.*```{kind}[^\S\n]*\n(.*?)```", 1))


def json_fence(c: Column) -> Column:
    """A text that is one JSON fence as its body; any other stripped."""
    body = F.regexp_extract(strip(c), r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(body != "", body).otherwise(strip(c))


def markdown_fence(c: Column) -> Column:
    """A text that is one Markdown fence as its body; any other stripped."""
    body = F.regexp_extract(strip(c), r"(?is)^```(?:markdown|md)?[^\S\n]*\n(.*?)\n?```$", 1)
    return F.when(body != "", strip(body)).otherwise(strip(c))


def slug(c: Column, most: int = 40) -> Column:
    """Lower case, other characters than a-z, 0-9 and - as -, long ones as their ends around a -."""
    s = F.regexp_replace(F.lower(c), "[^a-z0-9-]", "-")
    half = most // 2
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.left(s, F.lit(half)), F.lit("-"), F.right(s, F.lit(most - half - 1))))


def score_key(c: Column) -> Column:
    """The letters and digits of a score's label."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def timestamps(c: Column) -> Column:
    """Subtitle times of the shapes m:ss,mmm, mm:ss,mmm, hh:mm:ss,mmm and mm:ss,ss,mmm as HH:MM:SS,mmm.

    Times are marked where they are found, longest shape first, and rewritten from their fields, so that a
    rewritten time is not found again.
    """
    mark = "\u0001"
    shapes = (
        (r"(?<![0-9:])(\d{2,}):(\d{2}):(\d{2})[,:.](\d{3})(?!\d)", "$1", "$2", "$3", "$4"),
        (r"(?<![0-9:])(\d{2}):(\d{2})[,.](\d{2})[,:.](\d{3})(?!\d)", "00", "$2", "$3", "$4"),
        (r"(?<![0-9:])(\d{2}):(\d{2})[,:.](\d{3})(?!\d)", "00", "$1", "$2", "$3"),
        (r"(?<![0-9:])(\d):(\d{2})[,:.](\d{3})(?!\d)", "00", "0$1", "$2", "$3"),
    )
    for shape, *fields in shapes:
        c = F.regexp_replace(c, shape, mark.join(("", *fields, "")))
    return F.regexp_replace(c, f"{mark}(\\d+){mark}(\\d+){mark}(\\d+){mark}(\\d+){mark}", "$1:$2:$3,$4")


def duration(ms: Column) -> Column:
    """Milliseconds as m:ss."""
    s = F.expr("0").cast("long") + F.floor(ms / 1000)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))


def clock(seconds: Column) -> Column:
    """Seconds, cut and not below 0, as HH:MM:SS."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    two = lambda x: F.when(x < 10, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), two(F.pmod(s, F.lit(60))))


def epoch_text(c: Column, zone: str = "UTC") -> Column:
    """Seconds since 1970 as a zone's date and time; what is no number gives ''. Years over 9999 have no sign."""
    s = F.floor(c.try_cast("double"))
    at = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.floor(s / 86400).cast("int"), F.lit(0), F.lit(0), F.pmod(s, F.lit(86400)))
    told = F.convert_timezone(F.lit("UTC"), F.lit(zone), at).cast("string")
    return F.coalesce(F.when(F.startswith(told, F.lit("+")), F.substr(told, F.lit(2))).otherwise(told), F.lit(""))


def caption_suffix(family: Column, override: Column | None = None) -> Column:
    """The extension of a caption file: one given, else by family."""
    own = F.when(family.isin("audio", "video"), ".srt").when(family == "application", ".md").otherwise(".txt")
    if override is None:
        return own
    dotted = F.when(F.startswith(override, F.lit(".")), override).otherwise(F.concat(F.lit("."), override))
    return F.when(F.coalesce(override, F.lit("")) == "", own).otherwise(F.lower(dotted))


def is_object(c: Column) -> Column:
    """Whether a text is a JSON object."""
    bare = strip(c)
    return F.coalesce(F.startswith(bare, F.lit("{")) & F.endswith(bare, F.lit("}")) & F.try_parse_json(bare).isNotNull(), F.lit(False))


def json_objects(lines: Column) -> Column:
    """The lines that are JSON objects, stripped."""
    return F.filter(F.transform(F.coalesce(lines, F.array().cast("array<string>")), strip), is_object)


def described(payload: Column) -> Column:
    """The description that a JSON object tells: the long one, else the plain, else the short, else ''."""
    one = lambda k: F.nullif(F.get_json_object(payload, f"$.{k}"), F.lit(""))
    return F.coalesce(one("long_description"), one("description"), one("short_description"), F.lit(""))


def caption_body(suffix: Column, captions: Column) -> Column:
    """What a caption file holds: .srt by line, .md as it is, else a line each, stripped and without green font tags.

    Of a line that is a JSON object the description is written, without a line feed; blank lines go.
    """

    def plain(x: Column) -> Column:
        bare = strip(F.regexp_replace(x, r"(?i)<font color=[\"']?green[\"']?>|</font>", ""))
        return F.when(F.coalesce(bare, F.lit("")) == "", "").when(is_object(bare), described(bare)).otherwise(F.concat(bare, F.lit("\n")))

    return F.when(suffix == ".srt", F.array_join(captions, "\n")).when(suffix == ".md", F.array_join(captions, "")).otherwise(F.array_join(F.transform(captions, plain), ""))


def leaf_name(c: Column, default: str = "file") -> Column:
    """The last part of an untrusted path; nothing, . and .. give the default."""
    leaf = F.regexp_extract(c, r"([^/\\]*)[/\\]*$", 1)
    return F.when(leaf.isin("", ".", "..") | leaf.isNull(), default).otherwise(leaf)


#: Families of stems with the words that tell them; the first family with a word that a name holds counts.
STEM_FAMILIES = (
    ("vocals", ("vocal", "voice")),
    ("drums", ("drum", "percussion")),
    ("bass", ("bass",)),
    ("guitar", ("guitar",)),
    ("piano", ("piano", "keyboard", "keys")),
)


def stem_family(c: Column) -> Column:
    """A separated stem's family by its name, else `other`."""
    holds = lambda words: F.regexp_like(F.lower(c), F.lit("|".join(words)))
    return F.coalesce(*(F.when(holds(words), family) for family, words in STEM_FAMILIES), F.lit("other"))


def note_name(pitch: Column) -> Column:
    """A MIDI pitch as its nearest note with the cents to it: 60.12 is C4+12. Halves round to even."""
    near = F.bround(pitch, 0).cast("int")
    names = F.array(*map(F.lit, "C C# D D# E F F# G G# A A# B".split()))
    cents = F.bround((pitch - near) * 100, 0).cast("int")
    text = F.concat(F.element_at(names, F.pmod(near, F.lit(12)) + 1), (F.floor(near / 12) - 1).cast("string"))
    return F.when(cents == 0, text).otherwise(F.concat(text, F.when(cents > 0, "+").otherwise(""), cents.cast("string")))


def translation_prompt(text: Column, source: str, target: str, glossary: Column | None = None, context: Column | None = None) -> Column:
    """A sectioned prompt; sections without content are left out."""
    section = lambda title, c: F.when(F.coalesce(strip(c), F.lit("")) != "", F.concat(F.lit(f"[{title}]\n"), strip(c)))
    none = F.lit(None).cast("string")
    return F.concat_ws("\n\n", F.lit(f"Translate from {source} to {target}. Answer with the translation only."), section("Glossary", glossary if glossary is not None else none), section("Context", context if context is not None else none), section("Text", text))


# What a formula's preamble is made of, and what tells that a text has formulas.
PREAMBLE = r"(?i)\\documentclass\{[^}]+\}|\\usepackage\{[^}]+\}|\\usepackage\[[^\]]*\]\{[^}]+\}|\\begin\{document\}|\\end\{document\}"
LATEX = r"(?s)\$\$.*?\$\$|\$[^$\n]+?\$|\\[a-zA-Z]+|\\\[.*?\\\]|\\\(.*?\\\)"


def formula(c: Column) -> Column:
    """A recognized formula as a Markdown block: delimiters of blocks are made $$ on lines of their own, a document's preamble
    and backticks around it go. A text that has formulas inside, or none, stays."""
    t = strip(F.coalesce(c, F.lit("")))
    inner = strip(F.substring(t, F.lit(3), F.length(t) - 4))
    block = lambda x: F.concat(F.lit("$$\n"), x, F.lit("\n$$"))
    between = lambda a, b: F.startswith(t, F.lit(a)) & F.endswith(t, F.lit(b))
    bare = F.when(F.contains(t, F.lit("usepackage")), F.regexp_replace(t, PREAMBLE, "")).otherwise(t)
    bare = F.when(F.startswith(bare, F.lit("`")) & F.endswith(bare, F.lit("`")), F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    out = F.when(between("$$", "$$"), F.when(F.contains(inner, F.lit("$")), t).otherwise(block(inner))).when(between("\\[", "\\]"), block(inner))
    return out.when(F.regexp_like(t, F.lit(r"\\\[.*\\\]|\$[^$]+\$")) | ~F.regexp_like(t, F.lit(LATEX)), t).otherwise(block(bare))


def recognized_text(c: Column) -> Column:
    """A recognized text, stripped; an inline formula between backticks loses them."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when((F.left(t, F.lit(2)) == "`$") & (F.right(t, F.lit(2)) == "$`"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
