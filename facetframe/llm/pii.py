"""Personal data replaced by keyed surrogates, with column functions only.

1. One pattern finds e-mail addresses, phone, card, account and social security
   numbers, network addresses, access keys, secrets and names.
2. Each find is reduced to a canonical value of its kind (a phone number to its
   national digits, an address to lower case, a name to its words), so the same
   entity in another spelling has the same surrogate everywhere.
3. The surrogate is drawn from a keyed digest of kind and value: letters stay
   letters of their case, digits digits, card and account numbers keep valid check
   digits, addresses stay addresses; names keep title, gender and script.
4. Collision check: over the distinct values of the whole table, a surrogate that
   equals a real value of its kind, or that of another value, is drawn again until
   none is left. Only redrawn values (hardly ever any) are joined back, by a hash
   of the texts that hold them.

The distinct values are a partial aggregate, so an entity that a third of all rows
hold is one row per task. Texts are never shuffled unless some value was redrawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from facetframe.llm.base import kept, unused

MOST_DRAWS = 24

# Titles that tell a gender, and given names by gender.
MALE_TITLES = ("Mister", "Mr", "Herr", "Señor", "Monsieur", "Signor", "Господин", "господин", "г-н", "Κύριος", "κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mlle", "Signora", "Госпожа", "госпожа", "г-жа", "Κυρία", "κυρία")
OTHER_TITLES = ("Dr", "Prof")
MALE_NAMES = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Peter", "Paul", "Hans", "Jürgen", "Klaus", "Pierre", "Jean", "Carlos", "José", "Juan", "Иван", "Сергей", "Александр")
FEMALE_NAMES = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Sarah", "Anna", "Maria", "Ursula", "Sabine", "Petra", "Marie", "Claire", "Carmen", "Lucía", "María", "Анна", "Мария", "Елена")

_NAME = r"\p{Lu}[\p{Ll}]{1,24}"
_TITLES = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
_GIVEN = "|".join(MALE_NAMES + FEMALE_NAMES)
_SECRET_LEAD = r"""(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)["']?[ \t]{0,3}[=:][ \t]{0,3}["']?"""
PATTERNS = {
    "secret": _SECRET_LEAD + r"""(?=[^\s"',;0-9]*+[0-9])[^\s"',;]{6,}+""",
    "key": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "email": r"(?<![._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}){1,6}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:(?:{_TITLES})\.?[ ]{_NAME}(?:[ -]{_NAME}){{0,2}}|(?:{_GIVEN})[ ]{_NAME})(?!\p{{L}})",
}
# No find starts inside a word of ASCII letters and digits; testing that first skips most places at once.
_ANY = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
_TITLE_PART = rf"^((?:(?:{_TITLES})\.?[ ])?)"

_SYLLABLES = {
    "latin": (tuple("bdfgjklmnprstvwz"), tuple("aeiou"), {"m": ("en", "or", "us"), "f": ("a", "ia", "ena"), "n": ("er", "in", "and")}),
    "cyrillic": (tuple("бвгджзклмнпрстфх"), tuple("аеиоу"), {"m": ("ан", "ор", "ей"), "f": ("а", "ия", "ена"), "n": ("ен", "ик", "ун")}),
    "greek": (tuple("βγδζθκλμνξπρστφχ"), tuple("αειοω"), {"m": ("ος", "ης", "ων"), "f": ("α", "ια", "η"), "n": ("ης", "ας", "ου")}),
}


def _let(value: Column, use) -> Column:
    """Name a value inside an expression, so that it is built and computed once."""
    return F.transform(F.array(value), use)[0]


def _byte(digest: Column, i: Column | int) -> Column:
    at = (i if isinstance(i, Column) else F.lit(i)) % 64
    return F.conv(F.substr(digest, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _digest(key: str, kind: Column | str, value: Column, draw: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, draw.cast("string")).cast("binary"), 512)


def _pick(options: tuple[str, ...] | str, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (number % len(options) + 1).cast("int"))


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _same_shape(value: Column, digest: Column, hex_only: Column | None = None) -> Column:
    """A text of the same shape: each digit, lower or upper letter drawn anew, all else kept."""

    def draw(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        letters = F.lit(26) if hex_only is None else F.when(hex_only, 6).otherwise(26)
        return (
            F.when(c.between("0", "9"), (b % 10).cast("string"))
            .when(c.between("a", "z"), F.substr(F.lit(_LOWER), b % letters + 1, F.lit(1)))
            .when(c.between("A", "Z"), F.substr(F.lit(_UPPER), b % letters + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), draw), "")


def _secret(value: Column, digest: Column) -> Column:
    """A text of the same shape at any length: every 64 characters have a digest of their own."""

    def block(i: Column, hex_only: Column) -> Column:
        own = F.when(i == 0, digest).otherwise(F.sha2(F.concat_ws("\x1f", digest, i.cast("string")).cast("binary"), 512))
        return _let(own, lambda d: _same_shape(F.substr(value, i * 64 + 1, F.lit(64)), d, hex_only))

    blocks = F.sequence(F.lit(0), F.floor((F.length(value) - 1) / 64).cast("int"))
    hex_only = value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$")
    return _let(hex_only, lambda h: F.array_join(F.transform(blocks, lambda i: block(i, h)), ""))


def _refill(shape: Column, value: Column) -> Column:
    """Put the characters of a value in the places of ASCII letters and digits of a shape."""
    empty = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(state: Column, c: Column) -> Column:
        filled = c.rlike("[0-9A-Za-z]")
        new = F.when(filled, F.substr(value, state["at"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(state["out"], new).alias("out"), (state["at"] + F.when(filled, 1).otherwise(0)).alias("at"))

    # A value longer than its shape goes on behind it.
    filled = F.aggregate(F.split(shape, ""), empty, step)
    return _let(filled, lambda f: F.concat(f["out"], F.substr(value, f["at"])))


def _luhn(digits: Column) -> Column:
    """The check digit that digits call for."""

    def worth(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x)
    return F.pmod(-total, F.lit(10))


def _head(value: Column) -> Column:
    return F.substr(value, F.lit(1), F.length(value) - 1)


def _card(value: Column, digest: Column, more: Column) -> Column:
    """Same first digit and length, save for zeros more; the check digit is right if it was right."""
    body = F.concat(F.substr(value, F.lit(2), F.length(value) - 2), more)
    head = F.concat(F.substr(value, F.lit(1), F.lit(1)), _same_shape(body, digest))
    off = F.substr(value, F.length(value), F.lit(1)).cast("int") - _luhn(_head(value))
    return _let(head, lambda h: F.concat(h, F.pmod(_luhn(h) + off, F.lit(10)).cast("string")))


def _iban(value: Column, digest: Column) -> Column:
    """Same country and shape, with the check digits that belong to it."""
    country, account = F.substr(value, F.lit(1), F.lit(2)), _same_shape(F.substr(value, F.lit(5)), digest)

    def step(rest: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        worth = F.when(digit, c.try_cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(digit, 10).otherwise(100) + worth) % 97

    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), step)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _ip(digest: Column, draw: Column) -> Column:
    """Another address; a private one of eight groups from the third draw on, when the short ones run out."""
    groups = F.concat_ws(":", F.concat(F.lit("fd"), F.substr(digest, F.lit(1), F.lit(2))), *[F.substr(digest, F.lit(4 * i + 1), F.lit(4)) for i in range(1, 8)])
    parts = [(_byte(digest, 0) % 223 + 1), _byte(digest, 1), _byte(digest, 2), (_byte(digest, 3) % 254 + 1)]
    return F.when(draw > 1, groups).otherwise(F.concat_ws(".", *[p.cast("string") for p in parts]))


def _email(key: str, value: Column, draw: Column) -> Column:
    """Local part and first label of the domain anew; one domain always turns into the same."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    label = F.substring_index(domain, ".", 1)
    rest = F.substr(domain, F.length(label) + 1)
    return F.concat(
        _same_shape(F.concat(local, F.repeat(F.lit("a"), _growth(draw))), _digest(key, "email", value, draw)), F.lit("@"), _same_shape(label, _digest(key, "domain", domain, F.lit(0))), rest
    )


def _spoken(kind: Column, digest: Column, draw: Column) -> Column:
    """A word of syllables of the script, more of them with every growth; the ending follows the gender."""
    script, gender = F.substring_index(kind, "_", -1), F.substring_index(F.substring_index(kind, "_", 2), "_", -1)

    def choose(options) -> Column:
        out = F.lit(None).cast("array<string>")
        for name, entry in _SYLLABLES.items():
            for g in entry[2]:
                out = F.when((script == name) & (gender == g), F.array(*[F.lit(o) for o in options(entry, g)])).otherwise(out)
        return out

    def pick(options: Column, i: Column | int) -> Column:
        return F.element_at(options, F.pmod(_byte(digest, i), F.size(options)).cast("int") + 1)

    def spell(letters: Column) -> Column:
        syllables = F.transform(
            F.sequence(F.lit(1), F.when(kind.startswith("given"), 2).otherwise(3) + _growth(draw)),
            lambda i: F.concat(pick(letters["onsets"], i * 2), pick(letters["vowels"], i * 2 + 1)),
        )
        return F.concat(F.array_join(syllables, ""), pick(letters["onsets"], 20), pick(letters["tails"], 21))

    letters = F.struct(
        choose(lambda e, g: e[0]).alias("onsets"), choose(lambda e, g: e[1]).alias("vowels"), choose(lambda e, g: e[2][g]).alias("tails")
    )
    return _let(letters, spell)


def _growth(draw: Column) -> Column:
    """How much longer than its value a surrogate is: the first two draws keep the shape, then it grows."""
    return F.greatest(draw - 1, F.lit(0))


def surrogate(key: str, kind: Column, value: Column, draw: Column) -> Column:
    """The canonical surrogate of a canonical value, at its n-th draw.

    Values that fill the space of a shape meet over and over, so later draws take a
    longer shape, and every draw makes the space at least ten times larger.
    """
    first = F.substr(value, F.lit(1), F.lit(1))
    more = F.repeat(F.lit("0"), _growth(draw))
    longer = F.concat(value, more)

    def drawn(digest: Column) -> Column:
        rest = lambda n: _same_shape(F.substr(longer, F.lit(n)), digest)
        return (
            F.when(kind == "secret", _secret(longer, digest))
            .when(kind == "key", F.concat(F.substr(value, F.lit(1), F.lit(4)), rest(5)))
            .when(kind == "email", _email(key, value, draw))
            .when(kind == "iban", _iban(longer, digest))
            .when(kind == "ip", _ip(digest, draw))
            .when(kind == "card", _card(value, digest, more))
            .when(kind == "ssn", F.concat((_byte(digest, 61) % 8 + 1).cast("string"), rest(2)))
            .when((kind == "phone") & (first >= "2"), F.concat((_byte(digest, 60) % 8 + 2).cast("string"), rest(2)))
            .when(kind == "phone", _same_shape(longer, digest))
            .otherwise(_spoken(kind, digest, draw))
        )

    return _let(_digest(key, kind, value, draw), drawn)


def kind_of(found: Column) -> Column:
    """Which pattern a find belongs to."""
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(found.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name_words(found: Column) -> Column:
    """(kind, word) of the words of a name; gender from the title or else from the given name."""
    title = F.regexp_replace(F.regexp_extract(found, _TITLE_PART, 1), r"[. ]+$", "")
    words = F.split(F.regexp_replace(found, _TITLE_PART, ""), "[ -]")
    gender = (
        F.when(title.isin(*MALE_TITLES), "m")
        .when(title.isin(*FEMALE_TITLES), "f")
        .when(words[0].isin(*MALE_NAMES), "m")
        .when(words[0].isin(*FEMALE_NAMES), "f")
        .otherwise("n")
    )

    def entry(word: Column, i: Column) -> Column:
        surname = i == F.size(words) - 1
        # A surname is drawn alike for all genders, so a family keeps its name.
        part = F.when(surname, F.lit("surname_n")).otherwise(F.concat(F.lit("given_"), gender))
        return F.struct(F.concat(part, F.lit("_"), _script(word)).alias("kind"), F.lower(word).alias("value"))

    return F.transform(words, entry)


def atoms(found: Column) -> Column:
    """(kind, canonical value) of a find: one for most kinds, one per word for names."""
    plain = F.regexp_replace(found, "[^0-9A-Za-z]", "")
    octets = F.transform(F.split(found, r"\."), lambda o: o.try_cast("int").cast("string"))

    def reduced(kind: Column) -> Column:
        value = (
            F.when(kind == "secret", F.regexp_replace(found, f"^{_SECRET_LEAD}", ""))
            .when(kind == "email", F.lower(found))
            .when(kind == "iban", plain)
            .when(kind == "ip", F.array_join(octets, "."))
            .when(kind.isin("card", "ssn"), _digits(found))
            .when(kind == "phone", F.right(_digits(found), F.lit(10)))
            .otherwise(found)
        )
        return F.when(kind == "name", _name_words(found)).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value"))))

    return _let(kind_of(found), reduced)


def _rendered(found: Column, key: str, draws: Column) -> Column:
    """A find in its own format with the surrogates of its values."""

    def draw(a: Column) -> Column:
        return F.coalesce(F.try_element_at(draws, F.concat_ws("\x1f", a["kind"], a["value"])), F.lit(0))

    def written(new: Column) -> Column:
        # Of each value its kind and surrogate.
        kind, first = new[0]["kind"], new[0]["new"]
        digits = _digits(found)
        # What goes before the last ten digits is the country's.
        national = F.concat(F.substr(digits, F.lit(1), F.greatest(F.length(digits) - 10, F.lit(0))), first)
        cased = F.when((found == F.upper(found)) & (found != F.lower(found)), F.upper(first)).otherwise(first)
        words = F.split(F.regexp_replace(found, _TITLE_PART, ""), "[ -]")
        named = F.zip_with(new, words, lambda n, w: F.when(w == F.upper(w), F.upper(n["new"])).otherwise(F.initcap(n["new"])))
        return (
            F.when(kind == "secret", F.concat(F.regexp_extract(found, f"^({_SECRET_LEAD})", 1), first))
            .when(kind == "email", cased)
            .when(kind.isin("key", "ip"), first)
            .when(kind.isin("card", "ssn", "iban"), _refill(found, first))
            .when(kind == "phone", _refill(found, national))
            .otherwise(F.concat(F.regexp_extract(found, _TITLE_PART, 1), F.array_join(named, " ")))
        )

    fresh = F.transform(
        atoms(found), lambda a: F.struct(a["kind"].alias("kind"), surrogate(key, a["kind"], a["value"], draw(a)).alias("new"))
    )
    return _let(fresh, written)


def finds(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))


def values(documents: DataFrame, text: str = "text") -> DataFrame:
    """The distinct (kind, value) of all texts."""
    found = documents.select(F.explode(finds(F.col(text))).alias("found")).select("found").distinct()
    return found.select(F.explode(atoms(F.col("found"))).alias("a")).select("a.kind", "a.value").distinct()


def redrawn(known: DataFrame, key: str, most: int = MOST_DRAWS) -> DataFrame | None:
    """(kind, value, draw) of the values whose first surrogate is taken; None if there are none.

    A surrogate is taken if it is a real value of its kind, or that of another value
    (the least value keeps it).
    """
    drawn = known.withColumn("draw", F.lit(0))
    for _ in range(most):
        given = drawn.withColumn("new", surrogate(key, F.col("kind"), F.col("value"), F.col("draw")))
        owners = given.groupBy("kind", "new").agg(F.min(F.struct("draw", "value"))["value"].alias("owner"), F.count("*").alias("n"))
        shared = given.join(owners.where("n > 1"), ["kind", "new"]).where("value != owner").select("kind", "value")
        real = given.join(known.withColumnRenamed("value", "new"), ["kind", "new"], "left_semi").select("kind", "value")
        taken = kept(shared.unionByName(real).distinct(), "taken")
        if taken.isEmpty():
            break
        again = taken.withColumn("more", F.lit(1))
        drawn = kept(
            drawn.join(again, ["kind", "value"], "left").select(
                "kind", "value", (F.col("draw") + F.coalesce("more", F.lit(0))).alias("draw")
            ),
            "draws",
        )
    else:
        raise RuntimeError(f"surrogates still collide after {most} draws, each with a larger space than the one before")
    changed = drawn.where("draw > 0")
    return None if changed.isEmpty() else changed


def replaced(documents: DataFrame, key: str, text: str = "text", added: tuple[str, str] = ("n_replaced", "kinds_replaced")) -> DataFrame:
    """The documents with all columns, the text replaced, and two columns more: how many finds, and their kinds.

    A null text stays null with nothing found; empty texts and repeated rows stay as
    they are, and long texts are read whole; equal entities of any rows get equal
    surrogates and different ones different surrogates. Columns that clash with the
    added ones are replaced, all others kept. An empty table gives no rows.
    """
    hashed, drawn_in, found_in = (unused(name, documents.columns) for name in ("text_hash", "draws", "found"))
    known = kept(values(documents, text), "entities")
    changed = redrawn(known, key)
    rows, draws = documents, F.lit(None).cast("map<string,int>")
    if changed is not None:
        held = documents.select(F.xxhash64(text).alias(hashed), F.explode(F.array_distinct(finds(F.col(text)))).alias("found")).distinct()
        atom = held.select(hashed, F.explode(atoms(F.col("found"))).alias("a")).select(hashed, "a.kind", "a.value").distinct()
        # Entries are bounded by the entities of one text.
        maps = atom.join(changed, ["kind", "value"]).groupBy(hashed).agg(
            F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "value"), "draw"))).alias(drawn_in)
        )
        rows = documents.withColumn(hashed, F.xxhash64(text)).join(maps, hashed, "left").drop(hashed)
        draws = F.col(drawn_in)
    rows = rows.withColumn(found_in, finds(F.col(text)))
    between = F.split(F.col(text), _ANY, -1)
    new = F.transform(found_in, lambda f: _rendered(f, key, draws))
    # Texts before, between and after the finds; the last has no find behind it.
    pieces = F.zip_with(between, new, lambda b, n: F.concat(b, F.coalesce(n, F.lit(""))))
    whole = F.when(F.size(found_in) > 0, F.array_join(pieces, "")).otherwise(F.col(text))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(found_in, kind_of))), ",")
    plain = [c for c in documents.columns if c not in added]
    return rows.select(
        *[whole.alias(c) if c == text else F.col(c) for c in plain],
        F.coalesce(F.size(found_in), F.lit(0)).cast("long").alias(added[0]),
        F.coalesce(kinds, F.lit("")).alias(added[1]),
    )
