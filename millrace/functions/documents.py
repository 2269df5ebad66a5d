"""Document functions that need a scan with state: Arrow-batched, small helpers by row, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What must be the same for equal results.
#: Marks that end a sentence, and what may follow them within it.
SENTENCE_MARKS, SENTENCE_CLOSERS = "。！？.!?", "\"')]"
#: What urls and paths begin with, besides a drive's letter; they end before white space and these characters.
ADDRESS_STARTS, DRIVE, ADDRESS_STOPS = ("http://", "https://", "\\\\", "../", "./", "/"), ":\\", ")>"
#: Fences of code, and the form of a placeholder.
FENCES, PLACEHOLDER = ("```", "~~~"), "__QLP_{}__"
#: Classes of <div> that become blocks: the language of their fence, or None for blocks without one.
BLOCK_CLASSES = {"code": "code", "pseudocode": "", "chart": "mermaid", "music": "abc", "image": None, "chemistry": None, "table": None, "formula": None}
#: Tags that part lines.
LINE_TAGS = ("br", "span", "div", "p", "section", "article", "main", "body", "html")
#: Lines of charts that only style them begin with one of these words or marks.
CHART_STYLE_WORDS, CHART_STYLE_MARKS = ("click", "style", "linkstyle", "stroke", "classdef", "class"), ("%%", "::icon")

_FENCE = re.compile(r"[ \t]*(```|~~~)")
_LIST = re.compile(r"[ \t]*(?:[-*+]|\d+[.)])\s")
_sentence_end = re.compile(f"[{re.escape(SENTENCE_MARKS)}]+[{re.escape(SENTENCE_CLOSERS)}]*(?:\\s+|$)")
_ROW_CHARS = set("-: ")


def _is_row(line: str) -> bool:
    line = line.strip()
    return line.startswith("|") and line.count("|") > 1


def _kind(lines: list[str], i: int) -> str:
    """What block a line that is not blank begins."""
    bare = lines[i].lstrip()
    if _FENCE.match(bare):
        return "code"
    if _is_row(lines[i]) and i + 1 < len(lines):
        under = lines[i + 1].strip()
        if under.startswith("|") and set(under.replace("|", "").strip()) <= _ROW_CHARS:
            return "table"
    if re.match(r"#{1,6}\s", bare):
        return "heading"
    return "quote" if bare.startswith(">") else "list" if _LIST.match(bare) else "paragraph"


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """(end, kind) of the blocks that a Markdown text falls into; blank lines belong to the block before.

    A line-by-line automaton: the open block says whether a line goes on with it.
    """
    lines = text.splitlines(keepends=True)
    at, end, open_kind, fence, blank, rows = 0, 0, None, "", False, 0
    for i, line in enumerate(lines):
        bare = line.strip()
        if open_kind == "code":
            goes_on = True
        elif not bare:
            goes_on = open_kind is not None and open_kind != "heading"
        elif open_kind == "table":
            goes_on = not blank and (rows < 2 or _is_row(line))
        elif open_kind == "quote":
            goes_on = bare.startswith(">")
        elif open_kind == "list":
            goes_on = not blank and (_LIST.match(line) is not None or len(line) - len(line.lstrip(" ")) >= 2)
        else:
            goes_on = open_kind == "paragraph" and not blank and _kind(lines, i) == "paragraph"
        if not goes_on:
            if open_kind is not None:
                yield end, open_kind
            open_kind = _kind(lines, i) if bare else None
            fence, rows = bare[:3] if open_kind == "code" else "", 0
            at_open = True
        else:
            at_open = False
        at += len(line)
        rows += 1
        blank = not bare
        if open_kind is not None:
            end = at
        if open_kind == "code" and not at_open and bare.startswith(fence):
            yield end, open_kind
            open_kind = None
    if open_kind is not None:
        yield end, open_kind


def _address(run: str) -> int:
    """Where in a run of characters that may belong to one a url or path begins, or -1; a bare beginning is none."""
    begins = [at for start in ADDRESS_STARTS if 0 <= (at := run.find(start)) < len(run) - len(start)]
    at = run.find(DRIVE)
    while 0 <= at < len(run) - len(DRIVE):
        if at and run[at - 1].isascii() and run[at - 1].isalpha():
            begins.append(at - 1)
            break
        at = run.find(DRIVE, at + 1)
    return min(begins, default=-1)


def addresses(text: str, lo: int = 0, hi: int | None = None, stops: str = ADDRESS_STOPS) -> Iterator[tuple[int, int]]:
    """Spans of urls and paths in text[lo:hi]: each goes on to the end of its run."""
    for run in re.compile(rf"[^\s{re.escape(stops)}]+").finditer(text, lo, len(text) if hi is None else hi):
        if (at := _address(run[0])) >= 0:
            yield run.start() + at, run.end()


def _breaks(text: str, lo: int, hi: int, most: int) -> Iterator[int]:
    """Ends of pieces of at most `most` characters, each cut at the dearest place of its second half.

    After a line is dearer than after a word, and that than anywhere; of equal places the last is taken, which one
    search from the end finds. A piece that reaches `hi` need not be cut at a word.
    """
    while lo < hi:
        stop = min(hi, lo + most)
        cut, floor = stop, 1 if stop < hi else 2
        for at in range(stop, lo + most // 2 + 1, -1):
            price = 2 if text[at - 1] == "\n" else 1 if text[at - 1] == " " else 0
            if price >= floor:
                cut, floor = at, price + 1
                if price == 2:
                    break
        yield cut
        lo = cut


def _sentence_ends(text: str, lo: int, hi: int) -> Iterator[int]:
    """Ends of the sentences of text[lo:hi] whose marks stand in no url or path."""
    guarded = addresses(text, lo, hi) if any(c in text[lo:hi] for c in "/\\") else iter(())
    begin, end = next(guarded, (hi, hi))
    for mark in _sentence_end.finditer(text[lo:hi]):
        at = lo + mark.start()
        while end <= at < hi and begin < hi:
            begin, end = next(guarded, (hi, hi))
        if not begin <= at < end:
            yield lo + mark.end()


def _split(text: str, lo: int, hi: int, most: int) -> Iterator[int]:
    """Ends of pieces of text[lo:hi]: at sentences, and within longer ones at breaks."""
    for end in (*_sentence_ends(text, lo, hi), hi):
        if end > lo:
            yield from _breaks(text, lo, end, most) if end - lo > most else (end,)
            lo = end


def chunk_offsets(text: str | None, most: int = 2000) -> list[int]:
    """Ends of chunks of whole blocks of at most `most` characters; code and tables are not split, other long blocks are."""
    if most <= 0:
        raise ValueError("most must be positive")
    out: list[int] = []
    start = at = 0  # of the open chunk, of the block

    def close(end: int) -> None:
        if end > (out[-1] if out else 0):
            out.append(end)

    for end, kind in blocks(text or ""):
        if end - at > most and kind not in ("code", "table"):
            close(at)
            for cut in _split(text, at, end, most):
                close(cut)
            start = end
        elif end - start > most and at > start:
            close(at)
            start = at
        at = end
    if text:
        close(at)
        if not out:
            out = [*_split(text, 0, len(text), most)]
        out[-1] = len(text)
    return out


def slices(text: str | None, ends: list[int]) -> list[str]:
    return [(text or "")[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _code(text: str, at: int) -> tuple[int, int] | None:
    """The first span of code from `at` on: a closed fence, or a closed `...` within a line."""
    unclosed: set[str] = set()
    for m in re.compile("[`~]").finditer(text, at):
        mark = text[m.start() : m.start() + 3]
        if mark in FENCES and mark not in unclosed:
            end = text.find(mark, m.start() + 3)
            if end >= 0:
                return m.start(), end + 3
            unclosed.add(mark)
        if m[0] == "`":
            end, line = text.find("`", m.end()), text.find("\n", m.end())
            if end > m.end() and not m.end() <= line < end:
                return m.start(), end + 1
    return None


def protect(text: str | None) -> tuple[str, list[str]]:
    """Code, urls and paths as numbered placeholders, and what they stand for; what begins first is held first."""
    text = text or ""
    out, held, at = [], [], 0
    code, address, end = _code(text, 0), (0, 0), (len(text), len(text))
    while True:
        if code is not None and code[0] < at:
            code = _code(text, at)
        if address[0] < at or address == (0, 0):
            address = next(addresses(text, at, stops=ADDRESS_STOPS + "]"), end)
        lo, hi = min(code or end, address)
        if lo == len(text):
            return "".join([*out, text[at:]]), held
        out += [text[at:lo], PLACEHOLDER.format(len(held))]
        held.append(text[lo:hi])
        at = hi


def restore(text: str | None, held: list[str]) -> str:
    before, after = map(re.escape, PLACEHOLDER.split("{}"))
    return re.sub(rf"{before}(\d+){after}", lambda m: held[int(m[1])] if int(m[1]) < len(held) else m[0], text or "")


def repeated_tail(text: str | None, *, least: int = 8000, longest: int = 200, shortest: int = 1, chars: int = 100, times: int = 5) -> tuple[int, int] | None:
    """(period, length) of the repetition at a text's end with the smallest period, if it is long enough.

    The Z function of the reversed text tells for every period at once how far the text's end repeats with it.
    """
    s = (text or "")[::-1]
    n = len(s)
    if n < max(least, 2):
        return None
    z, left, right = [0] * (longest + 1), 0, 0
    for p in range(1, min(longest, n - 1) + 1):
        k = min(right - p, z[p - left]) if p < right else 0
        while p + k < n and s[k] == s[p + k]:
            k += 1
        z[p] = k
        if p + k > right:
            left, right = p, p + k
        if p >= shortest and k and k + p >= chars and (k + p) // p >= times:
            return p, k + p
    return None


def collapse_tail(text: str | None, **limits) -> str:
    """One unit of a repeated tail and what of a further one follows; a tail of numbered lines "1" goes as a whole."""
    text = text or ""
    found = repeated_tail(text, **limits)
    if found is None:
        return text
    period, length = found
    at = len(text) - length
    unit = text[at : at + period]
    if unit.strip() == "1" and "\n" in unit:
        return text[:at].rstrip()
    rest = length % period
    return text[: at + period] + (text[-rest:] if rest else "")


class _Markdown(HTMLParser):
    """Collects text; <div>s of a class of BLOCK_CLASSES are collected apart and written as blocks when they end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.depth = 0
        self.block: tuple[int, str, list[str]] | None = None  # the depth, class and text of the open block

    @property
    def into(self) -> list[str]:
        return self.out if self.block is None else self.block[2]

    def handle_data(self, data: str) -> None:
        self.into.append(data)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "div":
            self.depth += 1
            names = (dict(attrs).get("class") or "").split()
            name = next((n for n in BLOCK_CLASSES if n in names), None)
            if name is not None and self.block is None:
                self.block = (self.depth, name, [])
                return
        if tag in LINE_TAGS:
            self.into.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "div":
            if self.block is not None and self.block[0] == self.depth:
                self.end_block()
                self.depth -= 1
                return
            self.depth = max(self.depth - 1, 0)
        if tag in LINE_TAGS and tag != "br":
            self.into.append("\n")

    def end_block(self) -> None:
        (_, name, parts), self.block = self.block, None
        lines, fence = "".join(parts).replace("```", "").strip().split("\n"), BLOCK_CLASSES[name]
        if name == "music":
            lines = [x.rstrip() for x in lines if x.strip() and not x.strip().startswith("Z:")]
        if name == "chart":
            lines = ["" if _styles(x.strip().lower()) else x for x in lines]
        body = "\n".join(lines).strip()
        if body and fence is not None:
            head = "" if fence and name != "code" and body.startswith(fence) else f"{fence}\n"
            body = f"```{head}{body}\n```"
        self.out.append(f"\n\n{body}\n\n" if body else "")

    def text(self) -> str:
        self.close()
        if self.block is not None:
            self.end_block()
        return "".join(self.out)


def _styles(line: str) -> bool:
    word = re.match(r"\w*", line)[0]
    return word in CHART_STYLE_WORDS or line.startswith(CHART_STYLE_MARKS)


#: Ampersands that begin no closed reference, and what stands behind them while a parser reads them: no character.
_OPEN_REFERENCE, _NO_CHARACTER = re.compile(r"&(?!#?\w+;)"), "\ufdd0"


def html_to_markdown(text: str | None, *, closed: bool = False) -> str:
    """Text of HTML: marked blocks as fences, line tags as line feeds, all other tags gone.

    A block goes to its own end tag, whatever lies in it; one that does not end goes to the text's end. With `closed`,
    character references without a semicolon ("&amp" before a tag) stay as they are.
    """
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    if "<" in text and ">" in text:
        parser = _Markdown()
        parser.feed(_OPEN_REFERENCE.sub(f"&{_NO_CHARACTER}", text) if closed else text)
        made = parser.text().replace("\xa0", " ")
        text = re.sub(r"\n{3,}", "\n\n", made.replace(f"&{_NO_CHARACTER}", "&") if closed else made)
    return text.strip()


def decode(raw: bytes | None) -> str:
    """Bytes as text by the first of four encodings that fits; else with replacements."""
    for name in ("utf-8-sig", "gb18030", "utf-16"):
        try:
            return (raw or b"").decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "replace")


def column(f: Callable, kind: str):
    """A function of one value as an Arrow-batched column function; null gives what the function gives for None."""

    @F.pandas_udf(kind)
    def apply(values: pd.Series) -> pd.Series:
        return pd.Series([f(None if v is None else v) for v in values])

    return apply


@F.pandas_udf(T.ArrayType(T.StringType()))
def sliced(texts: pd.Series, ends: pd.Series) -> pd.Series:
    """The chunks of texts by their ends; in linear time, where substrings by position take quadratic."""
    return pd.Series([slices(t, [] if e is None else list(e)) for t, e in zip(texts, ends, strict=True)], dtype=object)
