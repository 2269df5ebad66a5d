"""Operator 10: line-first cleaning.

Each line is judged by itself: symbols, missing letters, navigation, boilerplate, shouting, missing
punctuation, monotony, and repetition of an earlier line of its document. Lines that fail are removed. A
document is rejected if it loses more than half of its text, or if it is short or repeats itself as a whole.
One pass, no shuffle: a document's verdict needs no other document.

Defined results: null and empty texts have no words and are rejected; repeated rows and doc_ids are judged
once per row; texts of any length are judged whole; an empty table gives no rows; other columns, of whatever name,
are ignored. Letters without case are letters, and lines of them do not shout; words are parted by white space in
all scripts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm._text import IS_SPACED, Words, constants, mix64, row_type, slices, utf8
from millrace.session import in_batches

MIN_WORDS, MOST_REPEATED, MOST_LOST = 50, 0.5, 0.5

#: Of lines of up to this many words, phrases such as these go if they make up a quarter of the words; by language.
BOILERPLATE_WORDS, BOILERPLATE_SHARE = 30, 0.25
BOILERPLATE = {
    "en": ("all rights reserved", "privacy policy", "terms of service", "terms of use", "accept cookies", "uses cookies", "cookie policy", "enable javascript", "click here", "sign in", "sign up", "log in", "subscribe to", "share on", "follow us", "skip to content", "back to top", "powered by", "lorem ipsum"),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "verwendet cookies", "javascript aktivieren", "hier klicken", "jetzt anmelden", "newsletter abonnieren", "folgen sie uns", "nach oben", "weiterlesen"),
    "fr": ("tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "accepter les cookies", "utilise des cookies", "cliquez ici", "se connecter", "abonnez-vous", "suivez-nous", "haut de page", "lire la suite"),
    "es": ("todos los derechos reservados", "política de privacidad", "términos de uso", "aceptar cookies", "utiliza cookies", "haga clic aquí", "iniciar sesión", "suscríbete", "síguenos", "volver arriba", "leer más"),
}
#: Lines of few words that begin with one of these and do not end as a sentence does are navigation.
NAVIGATION_WORDS = 6
NAVIGATION = {
    "en": ("home", "menu", "search", "next", "previous", "login", "contact", "sitemap", "read more"),
    "de": ("startseite", "menü", "suche", "weiter", "zurück", "kontakt", "impressum"),
    "fr": ("accueil", "recherche", "suivant", "précédent", "plan du site"),
    "es": ("inicio", "menú", "buscar", "siguiente", "anterior", "contacto"),
}
#: Sentence marks of Latin, Cyrillic and Greek, CJK, Arabic and Urdu, Hebrew, Indic, Armenian, Ethiopic, Khmer, Burmese and
#: Tibetan script, and what may follow them.
STOPS, CLOSERS = ".!?;…。！？．｡；؟؛۔׃।॥։።፧៖។៕။།༎", "\"'”’»)]"
#: Scripts that end sentences without a mark: Thai and Lao.
UNMARKED = "\u0e01-\u0e30\u0e81-\u0eb0"

_no_word = re.compile(r"\W+")


def phrases(lists: dict[str, tuple[str, ...]]) -> str:
    """A pattern for whole phrases of all languages in a line whose words are each between two single spaces."""
    every = dict.fromkeys(p for own in lists.values() for p in own)
    return " (?:" + "|".join(_no_word.sub("  ", p) for p in every) + ") "


_boilerplate, _navigation = re.compile(phrases(BOILERPLATE)), re.compile(phrases(NAVIGATION))
_symbols = re.compile(r"[#*$%&|<>{}=~^\\]")
_bars = re.compile(r"[|»›•·]")
_stops, _ended = re.compile(f"[{STOPS}]"), re.compile(rf"[{STOPS}][{re.escape(CLOSERS)}]*\s*$")
_unmarked = re.compile(f"[{UNMARKED}]")
_SAME, _SYMBOL = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_IN_LINE = np.ones(256, bool)
_IN_LINE[10] = False


def _mostly_cased(line: str) -> bool:
    """Whether more than half of a line's letters have case; most scripts have none, so their lines cannot shout."""
    letters = [c for c in line if c.isalpha()]
    return 2 * sum(c.lower() != c.upper() for c in letters) > len(letters)


def line_fails(line: str) -> str | None:
    """The name of the rule that a line fails, if any."""
    words = line.split()
    n, low = len(words), line.lower()
    if not n:
        return None
    if not any(map(str.isalpha, line)):
        return "letters"
    bars, plain = len(_bars.findall(line)), f" {_no_word.sub('  ', low).strip()} "
    if bars > 2 and bars > 0.2 * n or n <= NAVIGATION_WORDS and _navigation.match(plain) and not _ended.search(line):
        return "navigation"
    if len(_symbols.findall(line)) > 0.4 * n and n > 2:
        return "symbols"
    if n <= BOILERPLATE_WORDS and sum(len(p.split()) for p in _boilerplate.findall(plain)) >= max(1, BOILERPLATE_SHARE * n):
        return "boilerplate"
    if n >= 5 and line == line.upper() and _mostly_cased(line):
        return "shouting"
    if n >= 12 and not _stops.search(line) and (not _unmarked.search(line) or _mostly_cased(line)):
        return "punctuation"
    if n >= 20 and len({w.lower() for w in words}) < 0.3 * n:
        return "monotony"
    return None


def clean_lines(text: str) -> tuple[list[str], int]:
    """The lines that pass and the number of lines that fail; a repeated line fails from its second place on."""
    kept, failed, seen = [], 0, set()
    for line in text.split("\n"):
        bare = line.strip()
        if bare and (bare in seen or line_fails(line)):
            failed += 1
        else:
            kept.append(line)
        if bare:
            seen.add(bare)
    return kept, failed


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def _repeats(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each hash how often it occurs in its document."""
    _, back, n = np.unique(mix64(hashes ^ mix64(owner.astype(np.uint64) * constants(3, 1)[0])), return_inverse=True, return_counts=True)
    return n[back]


def counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document of a slice."""
    n = len(at) - 1
    words = Words(data, at, IS_SPACED, _SAME)
    out = {"n_words": words.counts(), "word_chars": _sums(IS_SPACED[data] & ((data & 0xC0) != 0x80), at), "n_symbols": _sums(_SYMBOL[data], at)}
    lines = Words(data, at, _IN_LINE, _SAME)
    full = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    owner = np.searchsorted(at, lines.start, side="right") - 1
    hashes, owner = lines.hash[full], owner[full]
    _, first = np.unique(mix64(hashes ^ mix64(owner.astype(np.uint64) * constants(3, 1)[0])), return_index=True)
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)
    grams, begin = words.grams(3)
    twice = begin[_repeats(grams, np.searchsorted(words.first, begin, side="right") - 1) > 1]
    hit = np.zeros(len(words.start), bool)
    for j in range(3):
        hit[twice + j] = True
    out["n_repeat_words"] = _sums(hit, words.first)
    return out


def _judge(batches: Iterator[pa.RecordBatch], with_text: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, data = utf8(batch.column("text"))
        for lo, hi in slices(at):
            c = counts(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            failed = (c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
            removed, kept, texts = [], [], []
            for i in range(lo, hi):
                text = data[at[i] : at[i + 1]].tobytes().decode()
                lines, n = clean_lines(text)
                cleaned = "\n".join(lines)
                removed.append(n)
                kept.append(not failed[i - lo] and len(cleaned) >= (1 - MOST_LOST) * len(text))
                texts.append(cleaned)
            columns = [batch.column("doc_id")[lo:hi], *(pa.array(c[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(removed, pa.int64()), pa.array(kept)]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def judge(docs: DataFrame, *, with_text: bool = True) -> DataFrame:
    """doc_id, the counts, base_failed, lines_removed, kept and (with_text) the cleaned text of each document."""
    kind, arrow = row_type("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines_removed long, kept boolean" + ", cleaned string" * with_text, doc_id=docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").transform(in_batches, lambda it: _judge(it, with_text, arrow), kind)
