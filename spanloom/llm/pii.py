"""Keyed surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern in one pass over each text, typed, and brought to a canonical form, so that mentions
of one entity that differ in case, punctuation, title or country code co-refer.  A person is a surname and a given
name: every mention of a surname, with whatever title or given name or, in the same text, alone, gets the same
surrogate surname; given names are exchanged within their gender and script by a keyed permutation.  The distinct entities, wherever
they stand, get surrogates from a keyed digest: of the same type, script, length and check digits, with known key
prefixes, and in a reserved domain.  Collision checks over all entities (two with one surrogate, or a surrogate
that is a real entity) draw again, for the collided ones only, and longer each time, so that the surrogates of a
full shape never run out.  Each mention is then written in its own format: the surrogate's characters take the
places of its letters and digits, in its case.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import exactly, free_name, materialize

# Titles and given names that say a person's gender, by script, and syllables of surnames.
TITLES_M = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Signor", "Sir", "Господин")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Signora", "Madam", "Госпожа")
TITLES_N = ("Dr", "Prof", "Professor", "Доктор")
GIVEN = {
    ("latin", "m"): ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Peter", "Paul", "Hans", "Klaus", "Jürgen", "Pierre", "Jean", "Carlos", "José", "Luis", "Miguel", "Antonio", "Marco"),
    ("latin", "f"): ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Emma", "Laura", "Ursula", "Monika", "Sabine", "Marie", "Claire", "Sophie", "María", "Carmen", "Lucía", "Elena", "Giulia"),
    ("cyrillic", "m"): ("Иван", "Пётр", "Алексей", "Сергей", "Дмитрий", "Николай", "Андрей", "Михаил"),
    ("cyrillic", "f"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"),
}
SYLLABLES = {
    "latin": ("bar", "bel", "cor", "dan", "del", "fen", "gar", "hol", "jen", "kel", "lam", "lor", "mar", "mon", "nor", "pel", "ran", "ros", "sal", "tam", "ter", "val", "ver", "win"),
    "cyrillic": ("бар", "вол", "гор", "дан", "ерм", "жел", "кор", "лаз", "мар", "нов", "пет", "ром", "сид", "тар", "фед", "чер"),
}
SURNAME_END = {"latin": "son", "cyrillic": "ко"}

_TITLES = "|".join(sorted({*TITLES_M, *TITLES_F, *TITLES_N}, key=lambda t: (-len(t), t)))
_NAMES = "|".join(sorted({n for g in GIVEN.values() for n in g}, key=lambda t: (-len(t), t)))
#: Words that a person's name follows.
CUES = ("my name is", "My name is", "Name:", "name:", "Signed by", "signed by", "Sincerely,", "Regards,", "Dear", "Author:", "Contact:", "Patient:", "Customer:")
PHONE_CUES = ("phone", "Phone", "tel", "Tel", "tel.", "Tel.", "mobile", "Mobile", "fax", "Fax", "call", "Call")
_WORD = r"\p{Lu}[\p{Ll}'’]++(?:-\p{Lu}\p{Ll}++)?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_PREFIX = "sk|pk|ghp|gho|ghs|xoxb|xoxp|AKIA|ASIA"
_KEYWORD = "token|secret|passwd|password|api_key|api-key|apikey|access_key"
_HEXES = r"(?=[a-f]*+[0-9])[0-9a-f]{32,}+|(?=[A-F]*+[0-9])[0-9A-F]{32,}+"
_CUED = "|".join(CUES)
#: Types in order of precedence, and what they look like.
PATTERNS = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?-----END [A-Z ]*PRIVATE KEY-----",
    "jwt": r"(?<![\p{L}\p{N}_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}](?:[\p{L}\p{N}-]*+\.)++[A-Za-z]{2,24}(?![\p{L}\p{N}])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "mac": r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}+-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([-. ])[0-9]{3}\1[0-9]{4}|[0-9]{1,3}[ .-]\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}"
    rf"|(?<=(?:{'|'.join(PHONE_CUES).replace('.', chr(92) + '.')})[: ]{{1,2}})[0-9]{{10,11}})(?![\p{{L}}\p{{N}}])",
    "secret": rf"(?<![\p{{L}}\p{{N}}_+/-])(?:{_HEXES}|(?:{_PREFIX})[-_A-Za-z0-9]{{16,}}+|(?<=(?:{_KEYWORD})[\"']{{0,1}}[ ]{{0,2}}[:=][ ]{{0,2}}[\"']{{0,1}})[A-Za-z0-9+/_=.-]{{8,}}+)(?![\p{{L}}\p{{N}}_/+])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLES})\.? {_WORD}(?: {_WORD})?|(?:{_NAMES}) {_WORD}|(?<=(?:{_CUED}) ){_WORD}(?: {_WORD})?)(?![\p{{L}}\p{{N}}])",
}
ENTITY = "|".join(p.replace("([ -])", f"(?<{k}>[ -])").replace("([-. ])", f"(?<{k}>[-. ])").replace(r"\1", rf"\k<{k}>") for k, p in PATTERNS.items())
#: A person by title or given name; only capitals start one, so the pattern is cheap.
PERSON_HINT = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLES}|{_NAMES})\.? \p{{Lu}}"
#: Entities that may hold neither a digit nor @, besides persons and keyed secrets: keys by prefix, MAC, IPv6, tokens and key files.
KEY_HINT = r"(?=[spgxAe])(?<![\p{L}\p{N}_+/-])(?:(?:sk|pk|gh[pos]|xox[bp]|A[KS]IA)[-_A-Za-z0-9]{16}|eyJ)"
ADDRESS_HINT = r"(?:[A-Fa-f]{2}[:-]){5}[A-Fa-f]{2}|(?:[A-Fa-f]{1,4}:){7}[A-Fa-f]|[A-Fa-f]::[A-Fa-f]"
#: One of these, that the text doesn't hold, stands around its mentions while it is cut.
MARKERS = ("\x01", "\x02", "\x03", "\x04")


def may_hold(text: Column) -> Column:
    """Whether a text may hold an entity: true of all that do, and cheap."""
    colon, dash = F.contains(text, F.lit(":")), F.contains(text, F.lit("-"))
    keyed = F.contains(text, F.lit("=")) | colon
    secret = F.contains(text, F.lit("token")) | F.contains(text, F.lit("secret")) | F.contains(text, F.lit("passw")) | F.contains(text, F.lit("key"))
    cued = text.rlike(rf"(?:{_CUED}) \p{{Lu}}")
    return text.rlike("[@0-9]") | (keyed & secret) | text.rlike(PERSON_HINT) | cued | text.rlike(KEY_HINT) | F.contains(text, F.lit("PRIVATE KEY-----")) | (colon | dash) & text.rlike(ADDRESS_HINT)


def parts_of(text: Column) -> Column:
    """A text as gap, mention, gap, ..., gap; null if it holds no entity.  One pass, unless it holds all of ``MARKERS``."""
    marker = F.coalesce(*(F.when(~F.contains(text, F.lit(m)), F.lit(m)) for m in MARKERS))
    cut = F.split(F.regexp_replace(text, F.lit(ENTITY), F.concat(marker, F.lit("$0"), marker)), marker, -1)
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    gaps = F.split(text, F.lit(ENTITY), -1)
    slow = F.concat(F.flatten(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.array(g, m))), F.slice(gaps, -1, 1))
    parts = F.when(marker.isNotNull(), cut).otherwise(slow)
    return F.when(may_hold(text), F.when(F.size(parts) > 1, parts))


def kind_of(mention: Column) -> Column:
    """The type of a mention: the first pattern that it matches as a whole, its surroundings aside; ``none`` for digits without a card's check digit."""
    bare = {
        "secret": rf"{_HEXES}|(?:{_PREFIX})[-_A-Za-z0-9]{{16,}}+",
        "card": r"[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}",
        "phone": PATTERNS["phone"].split("|(?<=")[0].replace("([-. ])", "[-. ]").replace(r"\1", "[-. ]") + ")|[0-9]{10,11}",
        "person": rf"(?:(?:{_TITLES})\.? )?{_WORD}(?: {_WORD})?",
    }
    out = F.when(F.lit(False), F.lit(""))
    for kind, pattern in PATTERNS.items():
        named = F.lit(kind)
        if kind == "card":
            named = F.when(mention.rlike("^[0-9]+$") & (F.pmod(_luhn_sum(mention), F.lit(10)) != 0), "none").otherwise(named)
        out = out.when(mention.rlike(f"^(?:{bare.get(kind, pattern)})$"), named)
    return out.otherwise("secret")


def canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity share: letters and digits in lower case; addresses and keys as they are; a phone's last ten digits."""
    plain = F.lower(F.regexp_replace(mention, r"[^\p{L}\p{N}]", ""))
    phone = F.when(F.length(plain) > 10, F.substr(plain, F.length(plain) - 9)).otherwise(plain)
    return F.when(kind.isin("ip", "secret", "jwt", "pem"), mention).when(kind == "email", F.lower(mention)).when(kind == "phone", phone).otherwise(plain)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _stream(seed: Column, length: Column) -> Column:
    """Keyed bytes, as an array of ``length`` ints at least."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(length / F.lit(64)).cast("int")), lambda b: F.sha2(F.concat_ws("|", seed, b.cast("string")).cast("binary"), 512))
    hexes = F.array_join(blocks, "")
    return F.transform(F.sequence(F.lit(0), (F.length(hexes) / 2 - 1).cast("int")), lambda i: F.conv(F.substr(hexes, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))


def _pick(letters: str, byte: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(byte, F.lit(len(letters))) + 1, F.lit(1))


def _swap(c: Column, byte: Column) -> Column:
    """A character of the same class and script."""
    return (
        F.when(c.rlike("[0-9]"), _pick("0123456789", byte))
        .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", byte))
        .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", byte))
        .when(c.rlike(r"\p{IsCyrillic}"), _pick("абвгдежзиклмнопрстуфхцчшэюя", byte))
        .when(c.rlike(r"\p{IsGreek}"), _pick("αβγδεζηθικλμνξοπρστυφχψω", byte))
        .when(c.rlike(r"\p{IsHan}"), _pick("山水火木金土日月田中大小上下文本", byte))
        .when(c.rlike(r"\p{Lu}"), _pick("ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÜ", byte))
        .when(c.rlike(r"\p{L}"), _pick("àáâäçèéêëíîïñóôöùúü", byte))
        .otherwise(c)
    )


def _swapped(text: Column, stream: Column, hexadecimal: bool = False) -> Column:
    swap = (lambda c, b: F.when(c.rlike("[0-9a-f]"), _pick("0123456789abcdef", b)).when(c.rlike("[A-F]"), _pick("0123456789ABCDEF", b)).otherwise(c)) if hexadecimal else _swap
    return F.array_join(F.transform(_chars(text), lambda c, i: swap(c, F.get(stream, i))), "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits, the last one not doubled."""
    n = F.length(digits)
    each = F.transform(_chars(digits), lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 0, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """An IBAN's remainder, its first four characters moved to the end and letters as numbers."""
    moved = F.upper(F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4))))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(moved), F.lit(0), lambda a, c: F.pmod(a * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)))


def _seed(key: str) -> Column:
    return F.concat_ws("|", F.lit(key), "kind", "canon", F.col("attempt").cast("string"))


def _longer(attempt: Column) -> Column:
    """By how many characters a surrogate outgrows its entity: none at first, more with each further attempt."""
    return F.greatest(attempt - 2, F.lit(0))


def _template(kind: Column, canon: Column, attempt: Column) -> Column:
    """The form whose characters are swapped: the canonical one, repeated a little where it must get longer."""
    return F.concat(canon, F.repeat(F.substr(canon, F.length(canon)), _longer(attempt)))


def _core(kind: Column, canon: Column, gender: Column, script: Column, attempt: Column, s: Column, plain: Column) -> Column:
    """The surrogate of a canonical form at an attempt; ``s`` has the keyed bytes, ``plain`` the template with its characters swapped."""
    ip = F.array_join(F.transform(F.sequence(F.lit(0), 3 + F.floor(attempt / 12).cast("int")), lambda i: (F.pmod(F.get(s, i), F.lit(254)) + 1).cast("string")), ".")
    template = _template(kind, canon, attempt)
    at = F.instr(canon, "@")
    labels = F.length(canon) - at - F.length(F.substring_index(canon, ".", -1)) - 1
    local = _swapped(F.concat(F.substr(canon, F.lit(1), at - 1), F.repeat(F.lit("x"), _longer(attempt))), s)
    site = _swapped(F.substr(canon, at + 1, labels), F.slice(s, at, F.lit(1 << 20)))
    email = F.concat(local, F.lit("@"), site, F.lit(".example"))
    body = F.concat(F.substr(template, F.lit(1), F.lit(1)), F.substr(plain, F.lit(2), F.length(template) - 2))
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    card = F.when(F.pmod(_luhn_sum(canon), F.lit(10)) == 0, F.concat(body, check.cast("string"))).otherwise(plain)
    account = F.concat(F.substr(canon, F.lit(1), F.lit(2)), F.lit("00"), F.substr(plain, F.lit(5)))
    iban = F.when(_mod97(canon) == 1, F.concat(F.substr(account, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(account)).cast("string"), 2, "0"), F.substr(account, F.lit(5)))).otherwise(F.concat(F.substr(canon, F.lit(1), F.lit(2)), F.substr(plain, F.lit(3))))
    fixed = F.length(F.regexp_extract(canon, rf"^(?:(?:{_PREFIX})[-_]?|eyJ|)", 0))
    secret = F.when(canon.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), _swapped(template, s, True)).otherwise(F.concat(F.substr(canon, F.lit(1), fixed), F.substr(plain, fixed + 1)))
    edge = F.length(F.regexp_extract(canon, r"^-----BEGIN [A-Z ]*PRIVATE KEY-----", 0))
    foot = F.length(F.regexp_extract(canon, r"-----END [A-Z ]*PRIVATE KEY-----$", 0))
    pem = F.concat(F.substr(canon, F.lit(1), edge), F.substr(plain, edge + 1, F.length(canon) - edge - foot), F.repeat(F.lit("A"), _longer(attempt)), F.substr(canon, F.length(canon) - foot + 1))
    hexes = _swapped(template, s, True)
    name = F.lit("")
    for where in ("latin", "cyrillic"):
        parts = F.array(*map(F.lit, SYLLABLES[where]))
        syllable = lambda i: F.element_at(parts, F.pmod(F.aggregate(F.slice(s, 3 * i + 2, 3), F.lit(0), lambda a, x: a * 256 + x), F.size(parts)) + 1)  # noqa: B023, E731
        many = F.lit(2) + F.floor(attempt / 4).cast("int")
        stem = F.array_join(F.transform(F.sequence(F.lit(0), many), lambda i: syllable(F.pmod(i, F.lit(20)))), "")
        ending = F.when(kind == "surname", F.lit(SURNAME_END[where])).when(gender == "f", F.lit({"latin": "a", "cyrillic": "а"}[where])).otherwise(F.lit(""))
        name = F.when(script == where, F.lower(F.concat(stem, ending))).otherwise(name)
    return (
        F.when(kind == "ip", ip).when(kind == "email", email).when(kind == "card", card).when(kind == "iban", iban).when(kind == "pem", pem)
        .when(kind.isin("secret", "jwt"), secret).when(kind.isin("mac", "ipv6"), hexes).when(kind.isin("surname", "given"), name).otherwise(plain)
    )


def _written(kind: Column, mention: Column, core: Column) -> Column:
    """The surrogate in the mention's own format: separators, country code and case stay; what is longer follows."""
    chars = _chars(core)
    own = F.length(F.regexp_replace(mention, r"[^\p{L}\p{N}]", ""))
    kept = F.when(kind == "phone", F.greatest(own - 10, F.lit(0))).otherwise(F.lit(0))
    before = lambda i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
    cased = lambda c, new: F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)
    spaced = F.array_join(F.transform(_chars(mention), lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]") & (before(i) >= kept), cased(c, F.get(chars, (before(i) - kept).cast("int")))).otherwise(c)), "")
    spaced = F.concat(spaced, F.substr(core, own - kept + 1))
    local = F.instr(mention, "@") - 1
    email = F.array_join(F.transform(chars, lambda c, i: F.when(i < local, cased(F.substr(mention, i + 1, F.lit(1)), c)).otherwise(c)), "")
    return F.when(kind == "none", mention).when(kind.isin("ip", "secret", "jwt", "pem"), core).when(kind == "email", email).otherwise(spaced)


def _gender(mention: Column) -> Column:
    m = "|".join((*TITLES_M,)), "|".join((*TITLES_F,))
    male = "|".join(GIVEN["latin", "m"] + GIVEN["cyrillic", "m"])
    female = "|".join(GIVEN["latin", "f"] + GIVEN["cyrillic", "f"])
    return F.when(mention.rlike(rf"^(?:{m[0]})\.? |^(?:(?:{_TITLES})\.? )?(?:{male}) "), F.lit("m")).when(mention.rlike(rf"^(?:{m[1]})\.? |^(?:(?:{_TITLES})\.? )?(?:{female}) "), F.lit("f")).otherwise("n")


def _exchanged(key: str, given: Column) -> Column:
    """A listed given name's successor in a keyed order of its gender and script; null for other names."""
    pairs = []
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
        pairs += [F.lit(x) for a, b in zip(order, order[1:] + order[:1]) for x in (a, b)]
    return F.create_map(*pairs)[given]


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Adds ``core`` to distinct (kind, canon, gender, script): no two alike within a kind, none that is itself an entity.

    Only what collides is drawn again; each further attempt is a character longer, so this ends whatever shape is full.
    """
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = materialize(entities, "entities")
    real = whole.select("kind", F.lower("canon").alias("low")).distinct()
    now, settled, attempt = whole, None, 0
    while True:
        # bytes and swapped characters are columns, so that no later expression works them out again
        bytes_ = now.withColumn("attempt", F.lit(attempt)).repartition(parts).withColumn("bytes", _stream(_seed(key), F.greatest(F.length("canon") + attempt, F.lit(64))))
        swapped = bytes_.withColumn("plain", _swapped(_template(F.col("kind"), F.col("canon"), F.col("attempt")), F.col("bytes")))
        drawn = swapped.withColumn("core", _core(*map(F.col, ("kind", "canon", "gender", "script", "attempt", "bytes", "plain")))).drop("bytes", "plain", "attempt").withColumn("low", F.lower("core"))
        taken = real if settled is None else real.unionByName(settled.select("kind", F.lower("core").alias("low")))
        first = Window.partitionBy("kind", "low").orderBy("canon", "gender", "script")
        checked = drawn.join(taken.withColumn("taken", F.lit(True)).distinct(), ["kind", "low"], "left")
        checked = materialize(checked.withColumn("again", F.col("taken").isNotNull() | (F.row_number().over(first) > 1)).drop("low", "taken"), "surrogates")
        good = checked.filter(~F.col("again")).drop("again")
        settled = good if settled is None else settled.unionByName(good)
        now = checked.filter("again").drop("again", "core")
        if now.isEmpty():
            return settled
        attempt += 1


def pseudonymize(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``df`` with every entity of ``text_col`` replaced; with ``count_col`` also the number of mentions that the patterns found.

    The surrogate of an entity depends on ``key``, on the entity and, after a collision, on the others.  Null
    and empty texts and texts without entities stay as they are, byte for byte; so do all other columns, whatever their names.
    Repeated rows give repeated results; very long texts and entities are replaced whole; an empty table gives an empty result.
    """
    p, r, t = free_name(df, "parts"), free_name(df, "row"), exactly(text_col)
    staged = df.withColumn(p, parts_of(t)).withColumn(r, F.monotonically_increasing_id())
    # the parts hold the whole text, so that it is stored once
    staged = materialize(staged.withColumn(text_col, F.when(F.col(p).isNull(), t)), "parts", tidy=True)
    clean, marked = staged.filter(F.col(p).isNull()).drop(p, r), staged.filter(F.col(p).isNotNull())
    each = marked.select(F.col(r).alias("row"), F.posexplode(F.filter(p, lambda x, i: i % 2 == 1)).alias("at", "mention")).withColumn("kind", kind_of(F.col("mention")))
    bare = F.regexp_replace("mention", rf"^(?:{_TITLES})\.? ", "")
    words, person = F.split(bare, " "), F.col("kind") == "person"
    given, surname = F.when(F.size(words) > 1, words[0]), F.element_at(words, -1)
    script = lambda c: F.when(c.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise("latin")
    entity = lambda kind, canon, gender, where: F.struct(kind.alias("kind"), canon.alias("canon"), gender.alias("gender"), where.alias("script"))
    named = F.array(
        entity(F.lit("surname"), F.lower(surname), F.lit("-"), script(surname)),
        F.when(given.isNotNull() & _exchanged(key, given).isNull(), entity(F.lit("given"), F.lower(given), _gender(F.col("mention")), script(given))),
    )
    own = F.when(person, named).when(F.col("kind") != "none", F.array(entity(F.col("kind"), canonical(F.col("kind"), F.col("mention")), F.lit("-"), F.lit("-"))))
    each = materialize(each.withColumn("own", F.filter(own, lambda x: x.isNotNull())), "mentions")
    names = ["kind", "canon", "gender", "script"]
    lone = each.select("row", "at", F.posexplode("own").alias("k", "e")).select("row", "at", "k", "e.*")
    counted = materialize(lone.groupBy(*names).agg(F.count("*").alias("n")), "counted")
    known = surrogates(counted.select(*names), key)
    total = counted.agg(F.sum("n")).first()[0] or 0
    # frequent entities, of which there can be few, meet their mentions map-side
    hot = counted.filter(F.col("n") * 1000 >= max(total, 100_000)).select(*names)
    hot_known = F.broadcast(materialize(known.join(F.broadcast(hot), names, "left_semi"), "frequent"))
    rest = lone.join(F.broadcast(hot), names, "left_anti").join(known, names)
    met = lone.join(hot_known, names).unionByName(rest).groupBy("row", "at").agg(F.max(F.when(F.col("k") == 0, F.col("core"))).alias("core"), F.max(F.when(F.col("k") == 1, F.col("core"))).alias("core2"))
    found = each.drop("own").join(met, ["row", "at"], "left")
    title = F.regexp_extract("mention", rf"^(?:(?:{_TITLES})\.? )?", 0)
    new_given = F.when(given.isNotNull(), F.coalesce(_exchanged(key, given), F.initcap("core2")))
    full = F.concat(title, F.concat_ws(" ", new_given, F.initcap("core")))
    said = found.withColumn("new", F.when(person, full).otherwise(_written(F.col("kind"), F.col("mention"), F.col("core")))).withColumn("name", F.when(person, F.struct(surname.alias("old"), F.initcap("core").alias("new"))))
    by_row = said.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("new"), F.collect_set("name").alias("names"), F.sum((F.col("kind") != "none").cast("int")).alias("n"))
    by_row = by_row.select(F.col("row").alias(r), F.struct(F.transform("new", lambda x: x["new"]).alias("new"), "names", "n").alias(b := free_name(staged, "written")))
    done = marked.join(by_row, r)
    # a surname that the text gives a person stands for this person where it stands alone, too
    alone = lambda gap: F.aggregate(F.col(b)["names"], gap, lambda a, x: F.regexp_replace(a, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.lit("\\Q"), x["old"], F.lit("\\E"), F.lit(r"(?![\p{L}\p{N}])")), x["new"]))
    text = F.array_join(F.transform(p, lambda x, i: F.when(i % 2 == 1, F.get(F.col(b)["new"], F.floor(i / 2).cast("int"))).when(F.size(F.col(b)["names"]) > 0, alone(x)).otherwise(x)), "")
    done = done.withColumn(text_col, text)
    count = {count_col: F.col(b)["n"].cast("int")} if count_col else {}
    zero = {count_col: F.lit(0)} if count_col else {}
    columns = [exactly(c) for c in (*df.columns, *([count_col] if count_col else []))]
    return clean.withColumns(zero).select(*columns).unionByName(done.withColumns(count).select(*columns))
