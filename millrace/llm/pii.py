"""Operator 4: surrogates for personal data.

Entities are detected with one pattern, reduced to a canonical form (case, spacing and punctuation do not make
another person), and replaced by keyed surrogates of their type: digits become digits, letters letters, with the
entity's own case and punctuation. Addresses stay valid, card and bank account numbers keep valid check digits,
mail addresses of one domain keep sharing one, keys keep their prefix, and names after a title become names of that
gender and script. A document's persons that a title makes known are replaced where their names stand in it without a
title too: next to the other part of a name, and alone unless the word is a common one (`COMMON`, or a word that the
document also has in lower case), so that "in May" and "Young people" stay beside "Mr. Will Young".

All distinct entities get their surrogates in one table. Surrogates that two entities share, or that are
themselves entities of the corpus, are drawn again, and only those, from a space that grows with each try for names and
mail addresses. Types of a fixed form may have no room: where most of a form's space are entities (short numbers), what is
left after `ROUNDS` tries is dealt round, each entity getting the next one's form. As no drawn surrogate is an entity, that
is one to one too. So nothing ends for lack of room, distinct entities stay distinct, no entity keeps its form, and every
mention of one gets the same surrogate. Texts without entities
pass untouched. Texts with some are searched once, and what lies between their mentions is set aside; the mentions
alone are joined with their surrogates, salted, and come back by row. DataFrame functions only. All repetitions in
the patterns are bounded, so that no text exhausts a stack or takes more than linear time.

Defined results: null and empty texts stay; texts of any length are searched whole; repeated rows are handled once
per row; an empty table gives no rows; all other columns, of whatever name, are kept as they are. Not detected:
names without a title in documents where no title makes them known, names alone that are common words, dates of birth,
numbers of passports, and mail addresses with over 64 characters
before the @ or 13 labels after it (their ends are).
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize

#: Draws, after which what still clashes is dealt round; surrogates that are sent to all tasks to be compared.
ROUNDS, SALTS, MOST_BROADCAST = 12, 8, 200_000

#: Titles by the gender that they tell: male, female, neither.
TITLES = {
    "m": "Mr|Herr|Monsieur|Señor|Mister|Sir|Г-н|Господин",
    "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа|Госпожа",
    "n": "Dr|Prof|Professor|Doctor|Doktor|Docteur|Sgt|Capt|Lt|Rev|Др|Профессор|Доктор",
}
#: Words that are names and ordinary words too, months among them: alone they are no one's name.
COMMON = "april august june march may sunday spring summer autumn winter north south east west will mark bill grant read hope faith grace joy love rose young rich long short good king prince law".split()
#: First names that replace others of their gender and script.
FIRST = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noah Oscar Paul".split(),
    ("latin", "f"): "Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Klara Laura Maria Nora Olga Paula".split(),
    ("latin", "n"): "Alex Blair Casey Dana Eden Finley Gale Harper Jamie Kim Lee Morgan Nicky Parker Robin Sasha".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
    ("cyrillic", "f"): "Алла Белла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса".split(),
    ("cyrillic", "n"): "Женя Саша Валя Слава Шура Паша Миша Лёля Тоня Рома Вика Ника Веня Лера Стася Юля".split(),
}
#: Syllables of surrogate family names; every try takes one more.
SYLLABLES = {"latin": "bar den fel gor han jas kel lor mar nev por ros sel tor van wes".split(), "cyrillic": "бар ден фел гор хан яс кел лор мар нев пор рос сел тор ван вес".split()}
LEAST_SYLLABLES, MOST_SYLLABLES = 4, 16

_titles = "|".join(TITLES.values())
_WORD = r"\p{Lu}\p{L}{0,40}(?:['’-]\p{L}{2,40})?"
_HEX_WORD, _ALNUM = "[0-9A-Fa-f]{1,4}", "[A-Z0-9]"
#: What the keys of services begin with; their length tells them from words.
KEY_PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "AKIA", "ASIA", "AIza", "sk-", "sk_live_", "xoxb-", "xoxp-")
#: The types. All begin with a letter, a digit or one of _.%+- that no letter or digit comes before.
PATTERNS = {
    "email": r"[\p{L}\p{N}_.%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}+\.){1,12}\p{L}{2,24}",
    "key": rf"(?:{'|'.join(KEY_PREFIXES)})[A-Za-z0-9_-]{{16,128}}(?![A-Za-z0-9_-])",
    "secret": r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "iban": rf"[A-Z]{{2}}\d{{2}}(?: ?{_ALNUM}{{4}}){{2,7}}(?: ?{_ALNUM}{{1,3}})?(?![A-Za-z0-9])",
    "ipv6": rf"(?=[0-9A-Fa-f:]{{0,39}}\d)(?:(?:{_HEX_WORD}:){{7}}{_HEX_WORD}|(?:{_HEX_WORD}:){{1,6}}(?::{_HEX_WORD}){{1,6}})(?![0-9A-Za-z:])",
    "ip": r"(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|0\d{2,4}[ /-]\d{5,8}|\d{3}(?:\)[ .-]?|[ .-])\d{3}[ .-]\d{4})(?!\d)",
    "ssn": r"(?<!\d-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d-)\d{4}(?:[ -]?\d{4}){3}(?![\d-])",
    "name": rf"(?:(?:{_titles})\.? ){{1,3}}(?!(?:{_titles})\b){_WORD}(?: {_WORD})?",
}
#: Texts are searched once from left to right; only where a word begins, and by its first character, a type is tried.
_ANY = r"(?<![\p{L}\p{N}_])(?:%(email)s|(?=[\d+])(?:%(ip)s|%(phone)s|%(ssn)s|%(card)s)|(?=[0-9A-Fa-f])(?:%(secret)s|%(ipv6)s)|(?=[A-Zgsx])(?:%(key)s|%(iban)s)|(?=\p{Lu})%(name)s)" % PATTERNS
#: Words that may be a known person's name.
_CAPITAL = rf"(?<![\p{{L}}\p{{N}}_]){_WORD}(?![\p{{L}}\p{{N}}_])"
_HEX = "0123456789abcdef"

#: The type of `entity`; null where the check digits of what looks like a bank account number are wrong.
_bank = "upper(replace(entity, ' ', ''))"


def _mod97(c: str) -> str:
    """The remainder of an account number by 97: its first four characters go last, A to Z are 10 to 35."""
    turned = f"split(concat(substring({c}, 5), left({c}, 4)), '')"
    return f"aggregate({turned}, 0L, (n, d) -> case when d between '0' and '9' then (n * 10 + int(d)) % 97 when d between 'A' and 'Z' then (n * 100 + ascii(d) - 55) % 97 else n end)"


def _type() -> Column:
    entity, found = F.col("entity"), F.when(F.contains("entity", F.lit("@")), "email")
    for name in ("key", "secret", "iban", "ipv6", "ip", "phone", "ssn", "card"):
        fits = F.regexp_like(entity, F.lit(f"^(?:{PATTERNS[name]})$"))
        found = found.when(fits, F.when(F.expr(f"{_mod97(_bank)} = 1"), name) if name == "iban" else F.lit(name))
    return found.otherwise("name")


def _name_parts() -> tuple[Column, Column, Column]:
    """Titles with their spaces, first name (or '') and family name of `entity`."""
    title = F.regexp_extract("entity", rf"^(?:(?:{_titles})\.? )+", 0)
    words = F.split(F.expr("substring(entity, length(title) + 1)"), " ")
    return title, F.when(F.size(words) > 1, words[0]).otherwise(""), F.element_at(words, -1)


def _with_parts(mentions: DataFrame) -> DataFrame:
    """`mentions` (entity) with `kind`, the name parts, and `parts`: the (type, canonical) that a surrogate is made of."""
    title, first, last = _name_parts()
    rows = mentions.withColumn("kind", _type()).withColumn("title", title).withColumn("first", first).withColumn("last", last)
    gender = F.coalesce(*(F.when(F.regexp_like("title", F.lit(rf"(?:^| )(?:{TITLES[g]})\.? ")), g) for g in "mf"), F.lit("n"))
    script = F.when(F.regexp_like("last", F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")
    digits = F.regexp_replace("entity", r"\D", "")
    abroad = F.startswith("entity", F.lit("+")) & ~F.startswith(digits, F.lit("1"))
    pair = lambda t, c: F.struct(F.lit(t).alias("type") if isinstance(t, str) else t.alias("type"), c.alias("canonical"))
    of = {
        "email": [pair("email", F.lower("entity")), pair("domain", F.lower(F.substring_index("entity", "@", -1)))],
        "name": [pair(F.concat(F.lit("first_"), script, F.lit("_"), gender), F.lower("first")), pair(F.concat(F.lit("last_"), script), F.lower("last"))],
        "phone": [pair("phone", F.when(abroad, F.concat(F.lit("+"), digits)).when(F.startswith("entity", F.lit("0")), digits).otherwise(F.substring(digits, -10, 10)))],
        "card": [pair("card", digits)],
        "ssn": [pair("ssn", digits)],
        "key": [pair("key", F.col("entity"))],
        "iban": [pair("iban", F.expr(_bank))],
    }
    parts = F.when(F.col("kind").isNull(), F.array().cast("array<struct<type:string,canonical:string>>"))
    for kind, found in of.items():
        parts = parts.when(F.col("kind") == kind, F.array(*found))
    return rows.withColumn("parts", parts.otherwise(F.array(pair(F.col("kind"), F.lower("entity")))))


def _stream(key: str) -> Column:
    """512 keyed hexadecimal digits of (type, canonical, attempt), two for each character."""
    base = F.concat_ws("\x1f", F.lit(key), "type", "canonical", F.col("attempt").cast("string"))
    return F.concat(*(F.sha2(F.concat(base, F.lit(f"\x1f{i}")), 256) for i in range(8)))


def _byte(at: str) -> str:
    return f"cast(conv(substring(s, 2 * pmod({at}, 256) + 1, 2), 16, 10) as int)"


def _of(characters: str, at: str) -> str:
    return f"substring('{characters}', pmod({_byte(at)}, {len(characters)}) + 1, 1)"


#: Each digit becomes a digit and each letter a letter; all else stays.
_MAPPED = rf"array_join(transform(split(canonical, ''), (c, i) -> case when c between '0' and '9' then {_of(string.digits, 'i')} when c rlike '\\p{{L}}' then {_of(string.ascii_lowercase, 'i')} else c end), '')"
_HEXED = f"array_join(transform(split(canonical, ''), (c, i) -> case when c between '0' and '9' or c between 'a' and 'f' then {_of(_HEX, 'i')} else c end), '')"
_GROWN = f"case when attempt > 0 then array_join(transform(sequence(1, attempt), k -> {_of(string.ascii_lowercase, '200 + k')}), '') else '' end"
_LUHN = "pmod(aggregate(transform(split({0}, ''), (c, i) -> case when pmod(length({0}) - i, 2) = {1} then int(c) * 2 - case when int(c) > 4 then 9 else 0 end else int(c) end), 0, (x, y) -> x + y), 10)"


def _surrogate() -> Column:
    """The surrogate's canonical form, from `type`, `canonical`, `attempt`, the stream `s` and the mapped letters `m`."""
    account = "concat(left(canonical, 2), '00', upper(substring(m, 5)))"
    made = {
        "secret": _HEXED,
        "ipv6": _HEXED,
        "ip": f"concat_ws('.', transform(sequence(0, 3), i -> cast(1 + pmod({_byte('i')}, 254) as string)))",
        # The last digit makes the sum of a card number that was valid valid again; those of an account number are its check digits.
        "card": f"case when {_LUHN.format('canonical', 0)} = 0 then concat(left(m, 15), cast(pmod(10 - {_LUHN.format('left(m, 15)', 1)}, 10) as string)) else m end",
        "iban": f"concat(left(canonical, 2), lpad(cast(98 - {_mod97(account)} as string), 2, '0'), substring({account}, 5))",
        # Countries keep their first two digits, and a leading 0 stays; else area codes and exchanges begin with 2 to 9.
        "phone": f"case when left(canonical, 1) = '+' then concat(left(canonical, 3), substring(m, 4)) when left(canonical, 1) = '0' then concat('0', {_of('123456789', '0')}, substring(m, 3)) else concat({_of('23456789', '0')}, substring(m, 2, 2), {_of('23456789', '3')}, substring(m, 5)) end",
        "ssn": f"concat({_of('12345', '0')}, substring(m, 2, 3), {_of('123456789', '4')}, substring(m, 6, 3), {_of('123456789', '8')})",
        "key": "concat(regexp_extract(canonical, '^(?:%s)', 0), substring(m, length(regexp_extract(canonical, '^(?:%s)', 0)) + 1))" % (("|".join(KEY_PREFIXES),) * 2),
        # Local parts and domains grow by a letter with each try.
        "email": f"concat(substring_index(m, '@', 1), {_GROWN}, '@', substring_index(canonical, '@', -1))",
        "domain": f"concat({_GROWN}, left(m, length(m) - length(substring_index(canonical, '.', -1))), substring_index(canonical, '.', -1))",
    }
    out = F.when(F.lit(False), F.lit(""))
    for kind, sql in made.items():
        out = out.when(F.col("type") == kind, F.expr(sql))
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), F.expr(f"pmod({_byte(str(at))}, {len(words)}) + 1"))
    for (script, gender), names in FIRST.items():
        # With more people than names syllables tell them apart.
        more = F.concat(*(F.when(F.col("attempt") > k, pick(SYLLABLES[script], 5 + k)).otherwise("") for k in range(MOST_SYLLABLES)))
        name = F.lower(F.concat(pick(names, 0), F.when(F.col("attempt") > 0, F.concat(F.lit("-"), more)).otherwise("")))
        out = out.when(F.col("type") == f"first_{script}_{gender}", F.when(F.col("canonical") == "", "").otherwise(name))
    for script, syllables in SYLLABLES.items():
        out = out.when(F.col("type") == f"last_{script}", F.concat(*(F.when(F.col("attempt") + LEAST_SYLLABLES > k, pick(syllables, k)).otherwise("") for k in range(MOST_SYLLABLES))))
    return out.otherwise(F.col("m"))


def _drawn(found: DataFrame, key: str) -> DataFrame:
    """Adds `surrogate`, and `nth` among those that drew the same one."""
    drawn = found.select("type", "canonical", "attempt").withColumn("s", _stream(key)).withColumn("m", F.expr(_MAPPED))
    nth = F.row_number().over(Window.partitionBy("type", "surrogate").orderBy("canonical"))
    return drawn.select("type", "canonical", "attempt", _surrogate().alias("surrogate")).withColumn("nth", F.when(F.col("canonical") == "", 1).otherwise(nth))


def _dealt_round(left: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(type, canonical, surrogate): each of `left` gets the form of the next one of its type and shape.

    One that is alone in its shape gets the form of another entity of that shape, which has a drawn surrogate.
    """
    hexed = F.regexp_replace("canonical", "[0-9a-f]", "0")
    shape = F.when(F.col("type") == "ip", "").when(F.col("type").isin("ipv6", "secret"), hexed).otherwise(F.regexp_replace(F.regexp_replace("canonical", "[0-9]", "0"), r"\p{L}", "a")).alias("shape")
    around = Window.partitionBy("type", "shape")
    order = around.orderBy(F.sha2(F.concat_ws("\x1f", F.lit(key), "canonical"), 256))
    turned = left.select("type", "canonical", "surrogate", shape).withColumn("after", F.coalesce(F.lead("canonical").over(order), F.first("canonical").over(order)))
    ends = known.select("type", "canonical", shape).join(turned.select("type", "shape").distinct(), ["type", "shape"], "left_semi").groupBy("type", "shape").agg(F.min("canonical").alias("low"), F.max("canonical").alias("high"))
    other = F.when(F.col("low") != F.col("canonical"), F.col("low")).when(F.col("high") != F.col("canonical"), F.col("high")).otherwise(F.col("surrogate"))
    return turned.join(ends, ["type", "shape"], "left").select("type", "canonical", F.when(F.col("after") != F.col("canonical"), F.col("after")).otherwise(other).alias("surrogate"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(type, canonical, surrogate) of the distinct (type, canonical) in `entities`: one to one within a type."""
    known = materialize(entities.select("type", "canonical").distinct())
    taken = known.where("canonical <> ''").select("type", F.col("canonical").alias("surrogate"))
    pending, done = known.withColumn("attempt", F.lit(0)), None
    for attempt in range(ROUNDS):
        drawn = materialize(_drawn(pending, key))
        asked = drawn.where("nth = 1").select("type", "surrogate")
        asked = F.broadcast(asked) if attempt and left <= MOST_BROADCAST else asked
        hit = taken.join(asked, ["type", "surrogate"], "left_semi").distinct().withColumn("hit", F.lit(True))
        judged = drawn.join(hit, ["type", "surrogate"], "left").withColumn("good", (F.col("nth") == 1) & (F.col("hit").isNull() | (F.col("canonical") == "")))
        judged = materialize(judged.select("type", "canonical", "attempt", "surrogate", "good"))
        good = judged.where("good").select("type", "canonical", "surrogate")
        done, taken = good if done is None else done.unionByName(good), taken.unionByName(good.select("type", "surrogate"))
        left = judged.where("not good").count()
        if not left:
            return done
        pending = judged.where("not good").withColumn("attempt", F.col("attempt") + 1)
    return done.unionByName(_dealt_round(judged.where("not good"), known, key))


def _title_case(word: Column) -> Column:
    return F.array_join(F.transform(F.split(word, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 99))), "-")


def _written() -> Column:
    """The surrogate `one` (and `two`) in the layout of `entity`, which it replaces."""
    kind, entity = F.col("kind"), F.col("entity")
    # Digits of the surrogate take the places of the entity's from the right, characters of an account number from the left.
    after = "length(regexp_replace(substring(entity, i + 1, 999), '[^0-9]', ''))"
    fill = F.expr(f"array_join(transform(split(entity, ''), (c, i) -> case when not (c rlike '[0-9]') then c else coalesce(nullif(substring(one, length(one) - {after} + 1, int({after} <= length(one))), ''), c) end), '')")
    account = F.expr("array_join(transform(split(entity, ''), (c, i) -> case when c = ' ' then c else substring(one, i + 1 - (i - length(replace(substring(entity, 1, i), ' ', ''))), 1) end), '')")
    cased = F.expr("array_join(transform(split(whole, ''), (c, i) -> case when substring(entity, i + 1, 1) <> lower(substring(entity, i + 1, 1)) then upper(c) else c end), '')")
    name_case = lambda w, like: F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(w)).otherwise(_title_case(w))
    name = F.concat("title", F.when(F.col("first") != "", F.concat(name_case(F.col("one"), F.col("first")), F.lit(" "))).otherwise(""), name_case(F.col("two"), F.col("last")))
    out = F.when(kind.isNull(), entity).when(kind == "name", name).when(kind == "word", name_case(F.col("one"), entity)).when(kind.isin("phone", "card", "ssn"), fill).when(kind == "iban", account)
    return out.when(kind == "ip", F.col("one")).when(kind == "key", F.concat(F.regexp_extract(entity, f"^(?:{'|'.join(KEY_PREFIXES)})", 0), F.expr(f"substring(_cased, length(regexp_extract(entity, '^(?:{'|'.join(KEY_PREFIXES)})', 0)) + 1)"))).when(entity == F.upper(entity), F.upper("whole")).otherwise(cased)


def replace(docs: DataFrame, *, key: str, text: str = "text", into: str = "pii_found") -> DataFrame:
    """`docs` with entities in column `text` replaced, and a column `into` with their number by type.

    A column of that name in `docs` gives way. Mentions of known persons without a title count as names.
    """
    docs = docs.drop(into)
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)) if len(docs.columns) > 1 else F.struct(F.lit(1).alias("none"))
    whole = F.col(f"`{text}`")
    has = F.coalesce(F.regexp_like(whole, F.lit(_ANY)), F.lit(False))

    # One search: marks around what is found, at which the text is cut. Texts and mentions alternate, texts first and last.
    outer, inner = (f"﷐{uuid.uuid4().hex}﷑" for _ in range(2))
    cut = docs.where(has).select(F.monotonically_increasing_id().alias("uid"), rest.alias("rest"), F.split(F.regexp_replace(whole, _ANY, f"{outer}$0{outer}"), outer, -1).alias("parts"))
    titled = F.exists("parts", lambda p: F.regexp_like(p, F.lit(rf"^(?:{PATTERNS['name']})$")))
    mention = lambda t, found: F.struct(t.alias("text"), F.lit(found).alias("found"))

    def inside(part: Column) -> Column:  # capital words of documents that make a person known
        return F.transform(F.split(F.regexp_replace(part, _CAPITAL, f"{inner}$0{inner}"), inner, -1), lambda p: mention(p, False))

    # The parts of the names that titles make known, and those of them that are common words of the document.
    after_title = lambda p: F.split(F.lower(F.regexp_replace(p, rf"^(?:(?:{_titles})\.? )+", "")), " ")
    names = F.flatten(F.transform(F.filter("parts", lambda p: F.regexp_like(p, F.lit(rf"^(?:{PATTERNS['name']})$"))), after_title))
    lowered = F.array_intersect("names", F.regexp_extract_all(F.array_join(F.filter("parts", lambda p, i: i % 2 == 0), " "), F.lit(r"(?<![\p{L}\p{N}_])(\p{Ll}[\p{Ll}'’-]{0,80})(?![\p{L}\p{N}_])"), F.lit(1)))
    pieces = F.flatten(F.transform("parts", lambda p, i: F.when(i % 2 == 1, F.array(mention(p, True))).when(F.col("titled"), inside(p)).otherwise(F.array(mention(p, False)))))
    cut = cut.withColumn("titled", titled).withColumn("names", F.when(F.col("titled"), names).otherwise(F.array().cast("array<string>"))).withColumn("lowered", F.when(F.col("titled"), lowered).otherwise(F.array().cast("array<string>")))
    cut = cut.select("uid", "rest", "names", "lowered", pieces.alias("pieces"))
    odd = lambda want: F.filter("pieces", lambda p, i: i % 2 == want)
    cut = cut.select("uid", "rest", "names", "lowered", F.transform(odd(0), lambda p: p["text"]).alias("texts"), odd(1).alias("mentions"))
    neighbour = lambda i, at, gap: F.when(F.get("texts", gap) == " ", F.lower(F.get("mentions", at)["text"]))

    def sure(m: Column, i: Column) -> Column:
        word = F.lower(m["text"])
        near = lambda c: F.coalesce(F.array_contains("names", c) & (c != word), F.lit(False))
        common = word.isin(COMMON) | F.array_contains("lowered", word)
        return F.array_contains("names", word) & (~common | near(neighbour(i, F.when(i > 0, i - 1).otherwise(-1), i)) | near(neighbour(i, i + 1, i + 1)))

    cut = cut.withColumn("mentions", F.transform("mentions", lambda m, i: F.struct(m["text"].alias("text"), m["found"].alias("found"), F.when(m["found"], F.lit(False)).otherwise(sure(m, i)).alias("sure"))))
    cut = materialize(cut.select("uid", "rest", "texts", "mentions"))

    mentions = cut.select("uid", F.posexplode("mentions").alias("place", "m")).select("uid", "place", F.col("m.text").alias("entity"), F.col("m.found").alias("found"), F.col("m.sure").alias("sure"))
    entities = _with_parts(mentions.where("found").select("uid", "place", "entity"))
    # The names that titles make known in a document, with what replaces them.
    known = entities.where("kind = 'name'").select("uid", F.explode("parts").alias("p")).select("uid", F.col("p.canonical").alias("low"), "p").where("low <> ''").groupBy("uid", "low").agg(F.max("p").alias("p"))
    words = mentions.where("not found").withColumn("low", F.when(F.col("sure"), F.lower("entity"))).join(known, ["uid", "low"], "left")
    blank = F.lit("")
    words = words.select("uid", "place", "entity", F.when(F.col("p").isNotNull(), "word").alias("kind"), blank.alias("title"), blank.alias("first"), blank.alias("last"), F.when(F.col("p").isNotNull(), F.array("p")).otherwise(F.array().cast("array<struct<type:string,canonical:string>>")).alias("parts"))
    every = entities.unionByName(words)

    # Each distinct form is written once; a form that many mentions have is dealt over SALTS keys.
    forms = every.where("kind is not null").select("entity", "kind", "title", "first", "last", "parts").distinct()
    forms = materialize(forms)
    table = surrogates(forms.select(F.explode("parts").alias("p")).select("p.type", "p.canonical"), key)
    named = forms
    for n, part in ((1, "one"), (2, "two")):
        p = F.try_element_at("parts", F.lit(n))
        own = table.select(F.col("type").alias(f"type_{part}"), F.col("canonical").alias(f"canonical_{part}"), F.col("surrogate").alias(part))
        # Forms without a second part look for keys of their own, so none is hot.
        alone = F.concat(F.lit("\x1f"), "entity")
        named = named.withColumn(f"type_{part}", F.coalesce(p["type"], blank)).withColumn(f"canonical_{part}", F.coalesce(p["canonical"], alone)).join(own, [f"type_{part}", f"canonical_{part}"], "left")
    named = named.withColumn("whole", F.when(F.col("kind") == "email", F.concat(F.substring_index("one", "@", 1), F.lit("@"), F.col("two"))).otherwise(F.col("one")))
    named = named.withColumn("_cased", F.expr("array_join(transform(split(whole, ''), (c, i) -> case when substring(entity, i + 1, 1) <> lower(substring(entity, i + 1, 1)) then upper(c) else c end), '')"))
    written = named.select("entity", "kind", "parts", _written().alias("made"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    put = every.select("uid", "place", "entity", "kind", "parts", F.pmod("uid", F.lit(SALTS)).cast("int").alias("salt")).join(written, ["entity", "kind", "parts", "salt"], "left")
    by_row = put.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("made", "entity").alias("made")))), lambda p: p["made"]).alias("made"), *(F.count(F.when(F.col("kind").isin(k, "word") if k == "name" else F.col("kind") == k, 1)).alias(k) for k in PATTERNS))
    joined = cut.join(by_row, "uid")
    text_of = F.array_join(F.transform("texts", lambda t, i: F.concat(t, F.coalesce(F.get(F.col("made"), i), blank))), "")
    counts = lambda made: F.struct(*((F.col(k) if made else F.lit(0).cast("long")).alias(k) for k in PATTERNS)).alias(into)
    columns = lambda made: [(text_of.alias(text) if c == text else F.col(f"rest.`{c}`").alias(c)) if made else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns(True), counts(True)).unionByName(docs.where(~has).select(*columns(False), counts(False)))
