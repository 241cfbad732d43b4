"""Replacement of personal data by keyed surrogates of the same type and format.

Mentions are found by patterns. Names are found by a title before them; their words are then mentions wherever else they stand in that
document. A mention has one piece, a name one for each word; a piece stands for an entity: its kind and its canonical form
(digits only, lower case), so all mentions of an entity get the same surrogate, each written in its own format. Surrogates are drawn from a keyed hash and drawn again where they collide with another one or with an entity that is there.
Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conflux.llm.tables import packed, saved

FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
EITHER = ("Dr", "Prof")

_HONORIFIC = "|".join(FEMALE + MALE + EITHER)
_CAPITAL = r"[\p{Lu}&&[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]]"
# Anna, McDonald, O'Brien, Smith-Jones.
_NAME = rf"{_CAPITAL}(?:['’]{_CAPITAL})?\p{{Ll}}+(?:['’-]?{_CAPITAL}\p{{Ll}}+)*"
# What keys of widespread services begin with.
_KEY_START = r"(?:AKIA|ASIA|AIza|[spr]k_(?:live|test)_|gh[pousr]_|xox[abprs]-)"
# By kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?)+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "secret": r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,64}(?![\p{L}\p{N}])",
    "token": rf"(?<![\p{{L}}\p{{N}}]){_KEY_START}[0-9A-Za-z_-]{{15,250}}[0-9A-Za-z](?![\p{{L}}\p{{N}}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}-])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}]|-\d)",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\p{L}\p{N}-])\d{3}-\d{3}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_HONORIFIC})\.? {_NAME}(?: {_NAME}){{0,2}}(?![\p{{L}}\p{{N}}])",
}
ANY = "|".join(PATTERNS.values())
# In every mention; a quicker search.
_LIKELY = rf"[0-9@]|[A-Fa-f]{{32}}|{_HONORIFIC}|{_KEY_START}"

# Syllables of coined names by script, and what a given name ends in by gender.
_SYLLABLES = {
    "latin": "ba be da de fa ga ka la le lo ma me mi na ne no ra re ri ro sa se so ta te ti to va ve vi",
    "cyrillic": "ба ве га да ди ка ла ли ма ми на не ни по ра ре ри са се со та те ти то фа ха",
    "greek": "βα γε δα δι κα λα λε λι μα με μι να νε νι πα ρα ρε ρι σα σε τα τε τι φα",
}
_ENDINGS = {
    "latin": {"f": "na", "m": "rd", "x": "l", "s": "sen"},
    "cyrillic": {"f": "на", "m": "р", "x": "л", "s": "вич"},
    "greek": {"f": "να", "m": "ρος", "x": "λ", "s": "δης"},
}
# After so many drawings the space of an entity's format counts as used up, and its surrogates get longer.
ROUNDS = 16


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")


def _kind(mention: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(_matches(mention, PATTERNS[kind]), kind).otherwise(out)
    return out


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _pieces(mention: Column, kind: Column) -> Column:
    """The pieces of a mention: ``text``, ``kind`` (null for what stays as it is) and ``canonical``."""
    # Words and what is between them; the words after the last blank are the surname.
    words = F.regexp_extract_all(mention, F.lit(r"[^ -]+|[ -]"), F.lit(0))
    given = F.size(words) - F.array_position(F.reverse(words), " ").cast("int")
    title = F.regexp_replace(words[0], r"\.$", "")
    gender = F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m").otherwise("x")

    def piece(word: Column, i: Column) -> Column:
        role = F.concat(F.lit("name-"), _script(word), F.lit("-"), F.when(i > given, "s").otherwise(gender))
        role = F.when((i > 0) & ~word.isin(" ", "-"), role)
        return F.struct(word.alias("text"), role.alias("kind"), F.lower(word).alias("canonical"))

    digits = F.regexp_replace(mention, r"[^0-9]", "")
    plain = F.lower(F.regexp_replace(mention, " ", ""))
    canonical = F.when(kind.isin("card", "phone", "ssn"), digits).when(kind == "token", mention).otherwise(plain)
    # The country code's length is part of a phone's kind, as it stays.
    code = F.length(F.regexp_extract(mention, r"^\+(\d{1,3})[ .(-]", 1))
    full = F.when(kind == "phone", F.concat(F.lit("phone-"), code.cast("string"))).otherwise(kind)
    one = F.array(F.struct(mention.alias("text"), full.alias("kind"), canonical.alias("canonical")))
    return F.when(kind == "name", F.transform(words, piece)).otherwise(one)


def _number(stream: Column, i: Column, most: Column | int) -> Column:
    """A number below ``most`` from two hex digits of a stream of them; ``i`` counts from 0."""
    pair = F.substring(F.concat(stream, stream, stream), (i * 2 % 128 + 1).cast("int"), F.lit(2))
    return F.pmod(F.conv(pair, 16, 10).cast("int"), F.lit(most) if isinstance(most, int) else most)


def _luhn(digits: Column) -> Column:
    """The Luhn sum, modulo 10, of an array of digits as text."""

    def add(total: Column, pair: Column) -> Column:
        d, i = pair["d"].cast("int"), pair["i"]
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.size(digits) - i) % 2 == 0, doubled).otherwise(d)

    numbered = F.transform(digits, lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), add) % 10


def _letter(stream: Column, i: Column, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), _number(stream, i, len(alphabet)) + 1, F.lit(1))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def draw(kind: Column, canonical: Column, attempt: int, key: str) -> Column:
    """The surrogate of an entity, in canonical form: its length, classes of characters, fixed parts and Luhn sum are kept.

    Fixed are the country code of a phone, the country of an IBAN, the top domain of an address, what a token begins with.
    Non-Latin letters in an address become Latin ones.
    """
    seed = F.concat_ws("\x1f", F.lit(key), kind, F.lit(str(attempt)), canonical)
    stream = F.concat(F.sha2(seed, 256), F.sha2(F.concat(F.lit("2"), seed), 256))
    hexes, digits, letters = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz"

    def mapped(text: Column, keep: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            drawn = F.when(c.rlike(r"\d"), _letter(stream, i, digits)).when(c.rlike("[A-Z]"), _letter(stream, i, letters.upper()))
            drawn = drawn.when(c.rlike(r"\p{L}"), _letter(stream, i, letters))
            return F.when(i < keep, c).otherwise(F.coalesce(drawn, c))

        return F.array_join(F.transform(_chars(text), one), "")

    address = F.regexp_extract(canonical, r"^(.*)(\.[^.]+)$", 1)
    email = F.concat(mapped(address, F.lit(0)), F.regexp_extract(canonical, r"(\.[^.]+)$", 1))
    ip = F.array_join(F.transform(F.split(canonical, r"\."), lambda _, i: _number(stream, i, 254) + 1), ".")
    secret = F.array_join(F.transform(_chars(canonical), lambda _, i: _letter(stream, i, hexes)), "")
    code = F.coalesce(F.regexp_extract(kind, r"^phone-(\d)$", 1).try_cast("int"), F.lit(0))
    card = mapped(canonical, F.lit(0))
    body = F.substring(card, F.lit(1), F.length(card) - 1)
    lacking = F.pmod(_luhn(_chars(canonical)) - _luhn(_chars(F.concat(body, F.lit("0")))), F.lit(10))
    card = F.concat(body, lacking.cast("string"))
    out = (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "secret", secret)
        .when(kind == "iban", mapped(canonical, F.lit(2)))
        .when(kind == "token", mapped(canonical, F.length(F.regexp_extract(canonical, f"^{_KEY_START}", 0))))
        .when(kind == "card", card)
        .otherwise(mapped(canonical, code))
    )
    for script, syllables in _SYLLABLES.items():
        parts = F.array(*[F.lit(s) for s in syllables.split()])
        n_parts = len(syllables.split())
        # A coined name takes one syllable more after every fourth drawing, so its space is never used up.
        for role, end in _ENDINGS[script].items():
            drawn = [F.element_at(parts, _number(stream, F.lit(i), n_parts) + 1) for i in range(3 + attempt // 4)]
            out = F.when(kind == f"name-{script}-{role}", F.concat(*drawn, F.lit(end))).otherwise(out)
    return F.concat(out, F.lit(str(attempt))) if attempt >= ROUNDS else out


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that are few bytes but much work each, dealt to as many tasks as a shuffle has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canonical``, ``surrogate`` of distinct entities; no two of a kind share one, and none is an entity itself.

    Each round draws for those that are left. Of those that draw the same, the first in order gets it; the others, and those
    that drew an entity or a surrogate given before, draw again.
    """
    left = saved(entities.select("kind", "canonical").distinct(), "entities")
    known = left.select("kind", F.col("canonical").alias("surrogate"))
    given = None
    attempt = 0
    while not left.isEmpty():
        drawn = spread(left, "kind", "canonical").withColumn("surrogate", draw(F.col("kind"), F.col("canonical"), attempt, key))
        taken = known if given is None else known.unionByName(given.select("kind", "surrogate"))
        fresh = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        won = saved(fresh.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")), "surrogates")
        given = won if given is None else given.unionByName(won)
        left = saved(left.join(won, ["kind", "canonical"], "left_anti"), "entities")
        attempt += 1
    return given if given is not None else left.withColumn("surrogate", F.col("canonical"))


def _written(text: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate in the format of a mention's piece: separators, case and length as they are there."""

    def fill(state: Column, c: Column) -> Column:
        taken = F.substring(surrogate, state["i"] + 1, F.lit(1))
        digit = c.rlike(r"\d")
        return F.struct(
            F.concat(state["s"], F.when(digit, taken).otherwise(c)).alias("s"),
            (state["i"] + F.when(digit, 1).otherwise(0)).cast("int").alias("i"),
        )

    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("i"))
    filled = F.aggregate(_chars(text), start, fill)
    rest = F.concat(filled["s"], F.substring(surrogate, filled["i"] + 1, F.length(surrogate)))

    def cased(c: Column, i: Column) -> Column:
        upper = F.substring(text, i + 1, F.lit(1)).rlike(r"\p{Lu}")
        return F.when(upper, F.upper(c)).otherwise(c)

    same_case = F.array_join(F.transform(_chars(surrogate), cased), "")

    def fill_plain(state: Column, c: Column) -> Column:
        taken = F.upper(F.substring(surrogate, state["i"] + 1, F.lit(1)))
        blank = c == " "
        return F.struct(
            F.concat(state["s"], F.when(blank, c).otherwise(taken)).alias("s"),
            (state["i"] + F.when(blank, 0).otherwise(1)).cast("int").alias("i"),
        )

    spaced = F.aggregate(_chars(text), start, fill_plain)
    iban = F.concat(spaced["s"], F.substring(F.upper(surrogate), spaced["i"] + 1, F.length(surrogate)))
    numbers = kind.isin("card", "ssn") | kind.startswith("phone")
    capitals = (kind == "secret") & text.rlike("[A-F]") & ~text.rlike("[a-f]")
    out = F.when(numbers, rest).when(kind == "iban", iban).when(kind.startswith("name"), F.initcap(surrogate))
    return out.when(kind == "token", surrogate).when(capitals, F.upper(surrogate)).otherwise(same_case)


def _people(mentions: Column) -> Column:
    """The words of the names among a document's mentions: ``text``, ``kind``, ``canonical``, in order."""

    def words(mention: Column) -> Column:
        return F.filter(_pieces(mention, F.lit("name")), lambda p: p["kind"].isNotNull())

    names = F.filter(mentions, lambda m: _matches(m, PATTERNS["name"]))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(names, words))))


def replaced(docs: DataFrame, key: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (a struct of all columns), ``n_mentions`` and ``safe``, the text with all mentions replaced.

    One row for each row of ``docs``; a null text stays null. The same key and the same entities give the same surrogates,
    whatever documents they are in. A name's words without a title are replaced in the documents that have it with one.
    """
    content = F.col(f"row.`{text}`")
    rows = packed(docs)
    holds = F.coalesce(content.rlike(_LIKELY) & content.rlike(ANY), F.lit(False))
    # Only rows with mentions are moved about; the others are read again for the result.
    met = rows.where(holds).select(
        "row",
        F.col(f"row.`{id_column}`").alias("id"),
        F.xxhash64(content).alias("tie"),
        F.regexp_extract_all(content, F.lit(ANY), F.lit(0)).alias("mentions"),
    )
    met = met.withColumn("people", _people(F.col("mentions")))
    words = F.array_join(F.array_distinct(F.col("people.text")), "|")
    bare = F.concat(F.lit(r"|(?<![\p{L}\p{N}])(?:"), words, F.lit(r")(?![\p{L}\p{N}])"))
    met = met.withColumn("bare", F.when(F.size("people") > 0, bare))
    wider = F.concat(F.lit(ANY), F.col("bare"))
    mentions = F.when(F.col("bare").isNull(), F.col("mentions")).otherwise(F.regexp_extract_all(content, wider, F.lit(0)))
    met = saved(met.withColumn("mentions", mentions), "mentions")

    def with_role(mention: Column) -> Column:
        role = F.filter("people", lambda p: p["text"] == mention)
        return F.struct(mention.alias("mention"), F.coalesce(F.get(role, 0)["kind"], F.lit("")).alias("role"))

    each = met.select("id", "tie", F.posexplode(F.transform("mentions", with_role)).alias("pos", "found"))
    each = each.select("id", "tie", "pos", "found.*")
    distinct = spread(each.select("mention", "role").distinct(), "mention").withColumn("of", _kind(F.col("mention")))
    word = F.struct(F.col("mention").alias("text"), F.col("role").alias("kind"), F.lower("mention").alias("canonical"))
    parts = F.when(F.col("role") == "", _pieces(F.col("mention"), F.col("of"))).otherwise(F.array(word))
    pieces = distinct.select("mention", "role", F.posexplode(parts).alias("i", "piece"))
    pieces = saved(pieces.select("mention", "role", "i", "piece.text", "piece.kind", "piece.canonical"), "pieces")
    named_pieces = surrogates(pieces.where("kind is not null"), key)
    drawn = spread(pieces.join(named_pieces, ["kind", "canonical"], "left"), "mention")
    piece = F.when(F.col("surrogate").isNull(), F.col("text")).otherwise(_written(F.col("text"), F.col("kind"), F.col("surrogate")))
    whole = drawn.select("mention", "role", F.struct("i", piece.alias("new")).alias("part")).groupBy("mention", "role")
    whole = whole.agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["new"]), "").alias("new"))
    whole = saved(whole, "replacements")

    # Rows that agree in id and text are put together once.
    once = each.distinct().join(whole, ["mention", "role"]).groupBy("id", "tie")
    once = once.agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("news"))
    once = saved(once.select(F.col("id").alias("new_id"), F.col("tie").alias("new_tie"), F.col("news.new").alias("news")), "replaced")
    here = met.join(once, met["id"].eqNullSafe(once["new_id"]) & (met["tie"] == once["new_tie"]))
    between = F.split(content, F.when(F.col("bare").isNull(), F.lit(ANY)).otherwise(wider), -1)
    safe = F.array_join(F.zip_with(between, "news", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = here.select("row", F.array_size("news").cast("long").alias("n_mentions"), safe.alias("safe"))
    same = rows.where(~holds).select("row", F.lit(0).cast("long").alias("n_mentions"), content.alias("safe"))
    return changed.unionByName(same)
