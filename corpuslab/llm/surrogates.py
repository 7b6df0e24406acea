"""Surrogates for personal data: keyed, of the same kind and form, and distinct.

Entities are found by patterns. The same entity always gets the same
replacement, made from a keyed hash: digits for digits, letters for letters,
valid check digits, names of the same script and gender. Replacements are
checked against each other and against all entities of the corpus, and those
that collide are made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.skew import join_counted, with_possible
from corpuslab.session import materialize

# Titles that say who is meant, with their gender.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Señora", "Sra", "Госпожа", "г-жа")
MALE = ("Mr", "Herr", "Señor", "Sr", "Господин", "г-н")

# Draws in its own form before an identity gets a longer one.
DRAWS = 12

_TITLES = "|".join((*FEMALE, *MALE))
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})"

# The order matters: at one place the first kind that matches counts.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("key", r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])"),
    ("key", r"(?i:(?<![a-z])(?:token|secret|password|api_?key)) ?[=:] ?\"[^\"\s]{8,}\""),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", r"(?<![\d.])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\d.]?\d)"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("name", NAME),
)
# One capture group, the separator of a card number, is used inside.
ANY = "|".join(f"(?:{pattern})" for _, pattern in PATTERNS)

ONSETS = {"latin": "b d f g k l m n p r s t v z br tr".split(), "cyrillic": "б в г д ж к л м н п р с т х бр тр".split()}
VOWELS = {"latin": "a e i o".split(), "cyrillic": "а е и о".split()}
ENDINGS = {
    ("latin", "given", "f"): "na", ("latin", "given", "m"): "no", ("latin", "family", "f"): "lin", ("latin", "family", "m"): "lin",
    ("cyrillic", "given", "f"): "на", ("cyrillic", "given", "m"): "н",
    ("cyrillic", "family", "f"): "ова", ("cyrillic", "family", "m"): "ов",
}


def kind_of(entity: Column) -> Column:
    kind = F.lit("name")
    for name, pattern in reversed(PATTERNS[:-1]):
        kind = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def identity(kind: Column, entity: Column) -> Column:
    """What must be equal for two mentions to mean the same: case and punctuation do not matter."""
    digits = F.regexp_replace(entity, r"\D", "")
    return (
        F.when(kind == "email", F.lower(entity))
        .when(kind.isin("card", "phone", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(F.upper(entity), " ", ""))
        .otherwise(entity)
    )


def _stream(secret: Column, kind: Column, identity_: Column, attempt: Column) -> Column:
    """128 hexadecimal digits drawn from the key; longer entities use them round and round."""
    return F.sha2(F.concat_ws("\x1f", secret, kind, identity_, attempt.cast("string")), 512)


def _draw(stream: Column, at: Column, below: int) -> Column:
    """A number below 65536 / ``below`` classes, from four hexadecimal digits."""
    start = F.pmod(at * 4, F.lit(124)) + 1
    return F.conv(F.substring(stream, start, F.lit(4)), 16, 10).cast("int") % below


# What characters of a kind are replaced by.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (
    ("[0-9]", DIGITS),
    ("[a-z]", LOWER),
    ("[A-Z]", UPPER),
    (r"(?=\p{Lu})\p{IsCyrillic}", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"(?=\p{Lu})\p{IsGreek}", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねの"),
    (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノ"),
    (r"\p{IsHan}", "山川田中村木林森水火土金石花草竹米糸車門雨雪風音"),
    (r"\p{Lu}", "ÄÖÜÉÈÀÂÊÎÔÛÇÑÅØÆ"),
    (r"[\p{L}\p{M}]", "äöüéèàâêîôûçñåøæ"),
    (r"\p{N}", DIGITS),
)
SYMBOLS = "!#$%&*+-/=?@^_~"


def like_characters(value: Column, stream: Column, symbols: bool = False) -> Column:
    """A character of the same script and case, or a digit, for each; other signs stay unless ``symbols``."""

    def one(char: Column, at: Column) -> Column:
        def pick(alphabet: str) -> Column:
            return F.substring(F.lit(alphabet), _draw(stream, at, len(alphabet)) + 1, F.lit(1))

        chosen = F.when(char.between("0", "9"), pick(DIGITS)).when(char.between("a", "z"), pick(LOWER))
        chosen = chosen.when(char.between("A", "Z"), pick(UPPER)).when(char <= "~", pick(SYMBOLS) if symbols else char)
        for pattern, alphabet in ALPHABETS[3:]:
            chosen = chosen.when(char.rlike(pattern), pick(alphabet))
        return chosen.otherwise(pick(SYMBOLS) if symbols else char)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _hex_like(value: Column, stream: Column) -> Column:
    hexes = F.transform(F.split(value, ""), lambda char, at: F.when(char.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), _draw(stream, at, 16) + 1, F.lit(1))).otherwise(char))
    return F.array_join(hexes, "")


def _luhn(digits: Column) -> Column:
    """The last digit that makes the number valid; the given last one is ignored."""
    turned = F.transform(
        F.slice(F.reverse(F.split(digits, "")), 2, 64),
        lambda d, at: F.when(at % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")),
    )
    total = F.aggregate(turned, F.lit(0), lambda a, b: a + b)
    return ((10 - total % 10) % 10).cast("string")


def _card(value: Column, stream: Column) -> Column:
    made = like_characters(value, stream)
    return F.concat(F.substring(made, F.lit(1), F.length(made) - 1), _luhn(F.regexp_replace(made, r"\D", "")))


def _iban(value: Column, stream: Column) -> Column:
    made = F.concat(F.substring(value, 1, 2), F.lit("00"), like_characters(F.substring(value, F.lit(5), F.length(value)), stream))
    plain = F.regexp_replace(made, " ", "")
    turned = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        turned, F.lit(0), lambda a, c: (a * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97
    )
    return F.concat(F.substring(made, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(made, F.lit(5), F.length(made)))


def _ip(stream: Column) -> Column:
    return F.concat_ws(".", *((_draw(stream, F.lit(at), 223 if at == 0 else 254) + 1).cast("string") for at in range(4)))


def _email(value: Column, stream: Column) -> Column:
    local = F.substring_index(value, "@", 1)
    domain = F.concat(F.lit("mail"), _draw(stream, F.lit(30), 10000).cast("string"), F.lit(".example.org"))
    return F.concat(like_characters(local, stream), F.lit("@"), domain)


def _phone(value: Column, stream: Column) -> Column:
    """The country code and the punctuation stay."""
    code = F.regexp_extract(value, r"^\+\d{1,3}(?=\D)|^\+\d", 0)
    return F.concat(code, like_characters(F.substring(value, F.length(code) + 1, F.length(value)), stream))


def _syllables(stream: Column, script: str, count: int) -> Column:
    parts = []
    for at in range(count):
        parts.append(F.element_at(F.array(*map(F.lit, ONSETS[script])), _draw(stream, F.lit(2 * at), 16) + 1))
        parts.append(F.element_at(F.array(*map(F.lit, VOWELS[script])), _draw(stream, F.lit(2 * at + 1), 4) + 1))
    return F.concat(*parts)


def _wide(stream: Column) -> Column:
    """120 bits, for what has no room left in its own form."""
    return F.substring(stream, 1, 30)


def _name_word(kind: Column, word: Column, gender: Column, stream: Column, wide: Column) -> Column:
    made = None
    for script in ("latin", "cyrillic"):
        for role, count in (("given", 3), ("family", 4)):
            base = F.when(wide, _syllables(stream, script, 30)).otherwise(_syllables(stream, script, count))
            female, male = ENDINGS[script, role, "f"], ENDINGS[script, role, "m"]
            own = F.concat(F.initcap(base), F.when(gender == "f", female).otherwise(male))
            fits = (kind == role) & (word.rlike(r"\p{IsCyrillic}") if script == "cyrillic" else F.lit(True))
            made = own if made is None else F.when(fits, own).otherwise(made)
    return made


def surrogate(kind: Column, entity: Column, identity_: Column, stream: Column, wide: Column) -> Column:
    """What an entity's draw ``stream`` gives; a ``wide`` one has a longer form, distinct by 120 bits.

    Pass ``stream`` as a column: it is used in hundreds of places.
    """
    # "token = ..." keeps everything before the quoted value.
    label = F.regexp_extract(entity, r"^[^\"]*\"", 0)
    inner = F.substring(entity, F.length(label) + 1, F.length(entity) - F.length(label) - 1)
    hidden = F.when(inner.rlike("^[0-9a-f]+$"), _hex_like(inner, stream)).otherwise(like_characters(inner, stream, symbols=True))
    quoted = F.concat(label, F.when(wide, _wide(stream)).otherwise(hidden), F.lit('"'))
    fixed = F.regexp_extract(entity, "^(?:AKIA|gh[pousr]_|sk-)", 0)
    rest = F.when(wide, _wide(stream)).otherwise(like_characters(F.substring(entity, F.length(fixed) + 1, F.length(entity)), stream))
    key = F.when(label != "", quoted).otherwise(F.concat(fixed, rest))
    email = F.when(wide, F.concat(F.lit("u"), _wide(stream), F.lit("@mail.example.org"))).otherwise(_email(entity, stream))
    # Numbers are continued after a hyphen, two digits for four bits.
    more = F.concat(F.lit("-"), F.array_join(F.transform(F.split(_wide(stream), ""), lambda c: F.lpad(F.conv(c, 16, 10), 2, "0")), ""))
    number = (
        F.when(kind == "iban", _iban(entity, stream))
        .when(kind == "card", _card(entity, stream))
        .when(kind == "ip", _ip(stream))
        .when(kind == "phone", _phone(entity, stream))
        .otherwise(like_characters(entity, stream))
    )
    gender = F.substring_index(identity_, "|", -1)
    return (
        F.when(kind == "email", email)
        .when(kind == "key", key)
        .when(kind.isin("given", "family"), _name_word(kind, entity, gender, stream, wide))
        .otherwise(F.when(wide, F.concat(number, more)).otherwise(number))
    )


def _name_parts(names: DataFrame) -> DataFrame:
    """``(entity, title, kind, word, identity, place)``: the words of every name by what they are.

    A family name is one identity whoever bears it, unless its form tells the
    gender, as in Cyrillic script; a given name goes with its gender. So a
    person named in full, by family name or with another title stays one.
    """
    words = F.split("entity", " ")
    gender = F.when(F.regexp_replace(F.get(words, 0), r"\.", "").isin(*FEMALE), "f").otherwise("m")
    kinds = F.when(F.size(words) > 2, F.array(F.lit("given"), F.lit("family"))).otherwise(F.array(F.lit("family")))
    told = names.select("entity", F.get(words, 0).alias("title"), gender.alias("gender"), words.alias("words"), F.posexplode(kinds).alias("place", "kind"))
    word = F.get("words", F.col("place") + 1)
    shown = F.when((F.col("kind") == "given") | word.rlike(r"\p{IsCyrillic}"), F.col("gender")).otherwise("")
    return told.select("entity", "title", "kind", "place", word.alias("word"), F.concat_ws("|", F.lower(word), shown).alias("identity"))


def _shown(kind: Column, identity_: Column) -> Column:
    """What two replacements of a kind must not have in common."""
    return F.when(kind.isin("given", "family"), F.substring_index(identity_, "|", 1)).otherwise(identity_)


def _drawn(people: DataFrame, secret: str) -> DataFrame:
    """``(kind, identity, replacement)`` for ``people(kind, identity, entity)``, in at most ``DRAWS + 1`` rounds.

    An identity whose replacement another identity of its kind has too, or that
    is itself an identity of the corpus, draws again; the smallest keeps its
    own. What is still open after ``DRAWS`` draws, because its form has too
    little room, takes the longer form, which needs no check.
    """
    key = F.lit(secret)
    kind, own = F.col("kind"), F.col("identity")
    taken = people.select("kind", _shown(kind, own).alias("made_identity")).distinct()
    settled, open_ones = None, people.withColumn("attempt", F.lit(0))
    for attempt in range(DRAWS + 1):
        drawn = open_ones.withColumn("stream", _stream(key, kind, own, F.lit(attempt)))
        made = drawn.withColumn("made", surrogate(kind, F.col("entity"), own, F.col("stream"), F.lit(attempt >= DRAWS))).drop("stream")
        made_identity = F.when(kind.isin("given", "family"), F.lower("made")).otherwise(identity(kind, F.col("made")))
        # Written: pushed into the joins below, the expression of a draw would be there many times over.
        made = materialize(made.withColumn("made_identity", made_identity))
        if attempt < DRAWS:
            clear = made.join(taken, ["kind", "made_identity"], "left_anti")
            if settled is not None:
                clear = clear.join(settled, ["kind", "made_identity"], "left_anti")
            winners = clear.groupBy("kind", "made_identity").agg(F.min("identity").alias("identity"))
            made = clear.join(winners, ["kind", "made_identity", "identity"], "left_semi")
        won = made.select("kind", "identity", "made", "made_identity")
        settled = materialize(won if settled is None else settled.unionByName(won))
        open_ones = materialize(open_ones.join(settled, ["kind", "identity"], "left_anti"))
        if open_ones.isEmpty():
            break
    return settled.select("kind", "identity", F.col("made").alias("replacement"))


def assign_surrogates(mentions: DataFrame, secret: str) -> DataFrame:
    """A replacement for every distinct mention: ``(entity, kind, replacement, fan_in)``.

    Mentions of one identity differ in case or punctuation only and share the
    draw. Names are put together from the replacements of their words.
    """
    entities = materialize(
        mentions.groupBy("entity")
        .agg(F.count("*").alias("fan_in"))
        .withColumn("kind", kind_of(F.col("entity")))
        .withColumn("identity", identity(F.col("kind"), F.col("entity")))
    )
    parts = materialize(_name_parts(entities.filter("kind = 'name'")))
    words = parts.groupBy("kind", "identity").agg(F.min("word").alias("entity"))
    others = entities.filter("kind <> 'name'").groupBy("kind", "identity").agg(F.min("entity").alias("entity"))
    drawn = materialize(_drawn(materialize(others.unionByName(words)), secret))

    # The identity is what is drawn for; a mention keeps its own punctuation.
    forms = entities.filter("kind <> 'name'").select("kind", "identity", "entity", "fan_in")
    same = forms.join(drawn, ["kind", "identity"])
    plain = same.select("entity", "kind", _in_form(F.col("kind"), F.col("entity"), F.col("replacement")).alias("replacement"), "fan_in")

    counts = parts.groupBy("kind", "identity").agg(F.count("*").alias("met"))
    offered = materialize(drawn.join(counts, ["kind", "identity"]))
    named = join_counted(parts, offered, ["kind", "identity"], "met")
    named = named.groupBy("entity", "title").agg(F.array_sort(F.collect_list(F.struct("place", "replacement"))).alias("made"))
    named = named.select("entity", F.concat_ws(" ", "title", F.array_join(F.transform("made", lambda x: x["replacement"]), " ")).alias("replacement"))
    names = entities.filter("kind = 'name'").select("entity", "kind", "fan_in").join(named, "entity")
    return plain.unionByName(names.select("entity", "kind", "replacement", "fan_in"))


def _in_form(kind: Column, entity: Column, made: Column) -> Column:
    """A replacement in the form of the mention: its digits (and letters, of an IBAN) where the mention has some."""
    out = made
    for kinds, counted, others in ((("card", "phone", "ssn"), "[0-9]", "[^0-9]"), (("iban",), "[0-9A-Za-z]", "[^0-9A-Za-z]")):
        plain, signs = F.regexp_replace(made, others, ""), F.split(entity, "")
        place = lambda at: F.size(F.filter(F.slice(signs, 1, at), lambda x: x.rlike(counted))) + 1  # noqa: E731, B023
        put = F.transform(signs, lambda c, at: F.when(c.rlike(counted), F.substring(plain, place(at), F.lit(1))).otherwise(c))  # noqa: B023
        fits = F.length(plain) == F.length(F.regexp_replace(entity, others, ""))
        out = F.when(kind.isin(*kinds) & fits, F.array_join(put, "")).otherwise(out)
    return out


def replace_personal_data(
    docs: DataFrame, secret: str = "surrogates", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with personal data replaced, and ``n_entities`` and ``entities``.

    ``entities`` lists kind and replacement in the order of the text. A text
    without entities, empty or null, stays as it is with 0 and an empty list.
    Rows with the same key and text are replaced alike, each by itself. Columns
    of ``docs`` named ``n_entities`` or ``entities`` are replaced. All work is
    done by SQL functions. Keep ``secret`` out of the data: whoever has it can
    try out which entity gave a replacement.
    """
    names = [name for name in docs.columns if name not in ("n_entities", "entities")]
    # Columns used inside must not meet columns of the caller.
    one, two, found, maybe = (_unused(name, names) for name in ("one", "two", "found", "maybe"))
    docs = docs.select(*names).withColumn(one, F.xxhash64(key, text)).withColumn(two, F.hash(text, key))
    body = F.col(f"`{text}`").cast("string")
    nothing = F.array().cast("array<struct<kind: string, replacement: string>>")

    # The only search in all texts.
    dirty = F.coalesce(body.rlike(ANY), F.lit(False))
    mentions = materialize(
        docs.filter(dirty)
        .select(F.col(one).alias("one"), F.col(two).alias("two"), F.regexp_extract_all(body, F.lit(ANY), F.lit(0)).alias("found"))
        .dropDuplicates(["one", "two"])
        .select("one", "two", F.posexplode("found").alias("at", "entity"))
    )
    table = materialize(assign_surrogates(mentions.select("entity"), secret))
    # The mentions of a text are collected again, as many as the text holds.
    changed = materialize(
        join_counted(mentions, table, "entity", "fan_in")
        .groupBy("one", "two")
        .agg(F.array_sort(F.collect_list(F.struct("at", "kind", "replacement"))).alias(found))
        .withColumnsRenamed({"one": one, "two": two})
    )
    # Texts that cannot have mentions stay where they are; the join decides about the others.
    told = with_possible(docs, changed.select(one, two), [one, two], maybe)
    clean = told.filter(~F.col(maybe)).select(*names, F.lit(0).cast("bigint").alias("n_entities"), nothing.alias("entities"))
    joined = told.filter(F.col(maybe)).join(changed, [one, two], "left")
    has = F.col(found).isNotNull()
    gaps = F.split(body, ANY, -1)
    woven = F.zip_with(gaps, F.transform(found, lambda x: x["replacement"]), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
    entities = F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), x["replacement"].alias("replacement")))
    whole = F.when(has, F.array_join(woven, "")).otherwise(body)
    replaced = joined.select(
        *(whole.alias(name) if name == text else F.col(f"`{name}`") for name in names),
        F.when(has, F.size(found)).otherwise(0).cast("bigint").alias("n_entities"),
        F.coalesce(entities, nothing).alias("entities"),
    )
    return clean.unionByName(replaced)


def _unused(name: str, names: list[str]) -> str:
    taken = {other.lower() for other in names}
    while name.lower() in taken:
        name = f"_{name}"
    return name
