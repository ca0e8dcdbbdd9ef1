"""Personal data replaced by keyed surrogates of the same kind and form.

A detected value gives a surrogate through a keyed hash of its kind and canonical form, so
every mention of a value, in any document, gets the same one. Digits stay digits, letters
stay letters of their script and case, separators stay, a valid card number stays valid, a
name keeps its title's gender and its script. Values whose surrogates meet, or meet a value
that the corpus really holds, draw again until all are apart. Only DataFrame functions are
used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

# Titles by gender, and what surrogate names are made of, by script.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "Госпожа", "Κυρία"),
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος"),
}
SYLLABLES = {
    "latin": ("ba", "den", "fi", "gar", "hol", "jun", "kel", "lo", "mar", "nes", "or", "pel", "ri", "san",
              "tor", "ul", "ven", "wil", "yar", "zim"),
    "cyrillic": ("ба", "ден", "фи", "гар", "хол", "юн", "кел", "ло", "мар", "нес", "ор", "пел", "ри", "сан",
                 "тор", "ул", "вен", "вил", "яр", "зим"),
    "greek": ("βα", "δεν", "φι", "γαρ", "χολ", "ιον", "κελ", "λο", "μαρ", "νεσ", "ορ", "πελ", "ρι", "σαν",
              "τορ", "ουλ", "βεν", "ηλι", "αρ", "ζιμ"),
}
ENDINGS = {
    ("latin", "given_f"): ("a", "ia", "ina"), ("latin", "given_m"): ("o", "us", "an"),
    ("latin", "surname"): ("er", "son", "ez"),
    ("cyrillic", "given_f"): ("а", "ина", "ия"), ("cyrillic", "given_m"): ("ан", "ий", "ор"),
    ("cyrillic", "surname"): ("енко", "ук", "их"),
    ("greek", "given_f"): ("α", "ια", "ινα"), ("greek", "given_m"): ("ος", "ης", "ας"),
    ("greek", "surname"): ("ιδης", "ου", "ακης"),
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя",
             "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

#: Draws before a form grows, and before the search for free surrogates is given up.
GROWS_AFTER, MOST_DRAWS = 1, 40

_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_NAME = r"\p{Lu}\p{M}*+(?:['’]\p{Lu})?\p{Ll}[\p{L}\p{M}]*+"
_AFTER_KEY = r"(?<=(?i:token|secret|password|passwd|key)\s{0,2}[=:]\s{0,2}[\"']?)"
#: Kinds in the order in which a value is claimed.
PATTERNS = {
    # possessive groups are loops: others recurse, and a long run of labels would overflow the stack
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}0-9-]++(?:\.[\p{L}0-9-]*[\p{L}0-9])++",
    # to the end of the value: 16 plain characters show a secret, others may follow; the stop of a sentence stays out
    "secret": _AFTER_KEY + r"(?=[A-Za-z0-9_.~+/=-]{16})(?=[_.~+/=-]*+[A-Za-z0-9])"
                           r"[A-Za-z0-9_.~+/=:%$!*^#@-]{15,}[A-Za-z0-9_~+/=%$*^#@-]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    # 16 digits are a card, 13 to 19 are one if they are Luhn-valid (_kind)
    "card": r"(?<![0-9])(?:(?:[0-9]{4}[ -]){4}[0-9]{1,3}|(?:[0-9]{4}[ -]?){3}[0-9]{4}|[0-9]{13,19}"
            r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}(?:[ -][0-9]{3}){3}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
             r"|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
           r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
          r"(?!\.?[0-9])",
    "person": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?:[ -]{_NAME})*+",
}
#: Group 1 holds what was found as a secret.
ANY = "|".join(f"({p})" if kind == "secret" else p for kind, p in PATTERNS.items())


def _cheap(text: Column) -> Column:
    """No value lacks all of these: texts without them are passed by without the long patterns."""
    title = reduce(Column.__or__, [text.contains(t) for ts in TITLES.values() for t in ts])
    word = (text.contains("=") | text.contains(":")) & text.rlike("(?i)token|secret|passw|key")
    return text.rlike("[0-9@]") | text.contains("::") | title | word


def _whole(kind: str) -> str:
    # lookarounds see the match alone here, so only the value's own form counts
    return f"^(?:{PATTERNS[kind].replace(_AFTER_KEY, '')})$"


def _no_card(value: Column) -> Column:
    """Digits that look like a card but are not 16 and not Luhn-valid."""
    digits = F.regexp_replace(value, "[ -]", "")
    return value.rlike(_whole("card")) & (F.length(digits) != 16) & (_luhn(digits) != 0)


def _kind(value: Column, secret: Column) -> Column:
    kind = F.lit("secret")
    for name in ("person", "ip", "ssn", "ip6", "phone"):
        kind = F.when(value.rlike(_whole(name)), F.lit(name)).otherwise(kind)
    kind = F.when(~_no_card(value), F.when(value.rlike(_whole("card")), F.lit("card")).otherwise(kind)) \
        .otherwise(F.when(secret, F.lit("secret")).otherwise(F.lit("keep")))
    for name in ("iban", "email"):
        kind = F.when(value.rlike(_whole(name)), F.lit(name)).otherwise(kind)
    return kind


def _parts(value: Column, kind: Column) -> Column:
    """A value as (kind, canonical, form) parts: names word by word, anything else as a whole."""
    words = F.split(value, "(?<=[ -])|(?=[ -])", -1)
    female = value.rlike(rf"^(?:{'|'.join(TITLES['f'])})\.? ")
    n = F.size(words)

    def word(w: Column, i: Column) -> Column:
        name = F.when((i == 0) | w.rlike("^[ -]$"), F.lit("keep")).when(i == n - 1, F.lit("surname")) \
            .when(female, F.lit("given_f")).otherwise(F.lit("given_m"))
        return F.struct(name.alias("kind"), F.lower(w).alias("canonical"), w.alias("form"))

    def part(kind: Column, canonical: Column, form: Column) -> Column:
        return F.struct(kind.alias("kind"), canonical.alias("canonical"), form.alias("form"))

    def bare(x: Column) -> Column:
        return F.regexp_replace(x, "[^0-9A-Za-z]", "")

    canonical = F.when(kind.isin("card", "ssn", "iban", "phone"), bare(value)) \
        .when(kind == "ip6", F.lower(value)).otherwise(value)
    user, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    # no card as a whole: 16 digits before a further group still are one, and 6 and 4 digits a telephone number
    head, tail = F.substring(value, 1, 19), F.substring(value, F.lit(20), F.length(value))
    area, line = F.substring(value, 1, 5), F.substring(value, F.lit(6), F.length(value))
    return F.when(kind == "person", F.transform(words, word)) \
        .when(kind == "email", F.array(
            part(F.lit("mailbox"), F.lower(value), user), part(F.lit("keep"), F.lit("@"), F.lit("@")),
            part(F.lit("domain"), F.lower(domain), domain))) \
        .when((kind == "keep") & value.rlike("^(?:[0-9]{4}[ -]){4}"), F.array(
            part(F.lit("card"), bare(head), head), part(F.lit("keep"), tail, tail))) \
        .when((kind == "keep") & value.rlike("^[0-9]{4}[ -][0-9]{6}[ -][0-9]{4}$"), F.array(
            part(F.lit("keep"), area, area), part(F.lit("phone"), bare(line), line))) \
        .otherwise(F.array(part(kind, canonical, value)))


def _keyed(kind: Column, canonical: Column, key: str, attempt: Column) -> Column:
    """Blocks of 32 keyed bytes in hexadecimal, enough for one byte a character."""
    seed = F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string"))
    first = F.array(F.sha2(seed, 256), F.sha2(F.concat(F.lit("more|"), seed), 256))
    last = F.floor((F.length(canonical) - 1) / 32).cast("int")
    return F.when(last < 2, first).otherwise(F.concat(first, F.transform(
        F.sequence(F.lit(2), last), lambda j: F.sha2(F.concat_ws("|", j.cast("string"), F.get(first, F.lit(0))), 256))))


def _byte(h: Column, k: Column) -> Column:
    """The k-th keyed byte, again from the start after the last block."""
    block = F.get(h, F.pmod(F.floor(k / 32).cast("int"), F.size(h)))
    return F.conv(F.substring(block, F.lit(1) + F.pmod(k, F.lit(32)) * 2, F.lit(2)), 16, 10).cast("int")


def _pick(options: tuple[str, ...] | str, b: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(b, F.lit(len(options))))


def _letters(form: Column, h: Column, skip: Column) -> Column:
    """Each letter and digit exchanged for one of its kind, from ``skip`` characters on."""
    chars = F.split(form, "")

    def swap(c: Column, k: Column) -> Column:
        b = _byte(h, k)
        latin, cyrillic, greek = (_pick(ALPHABETS[s], b) for s in ("latin", "cyrillic", "greek"))
        low = F.when(c.rlike("\\p{IsCyrillic}"), cyrillic).when(c.rlike("\\p{IsGreek}"), greek).otherwise(latin)
        letter = F.when(c.rlike("\\p{Lu}"), F.upper(low)).otherwise(low)
        return F.when(k < skip, c).when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string")) \
            .when(c.rlike("\\p{L}"), letter).otherwise(c)
    return F.array_join(F.transform(chars, swap), "")


def _luhn(digits: Column) -> Column:
    """Sum of a number's digits with every second from the right doubled, modulo 10."""
    n = F.length(digits)
    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(
        F.substring(digits, k, F.lit(1)).cast("int").alias("d"), F.pmod(n - k, F.lit(2)).alias("odd"))),
        F.lit(0), lambda a, x: a + F.when(x["odd"] == 0, x["d"]).otherwise(
            F.when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2))), F.lit(10))


def _syllable(script: str, h: Column):
    return lambda k: _pick(SYLLABLES[script], _byte(h, k))


def _name(kind: Column, canonical: Column, h: Column, attempt: Column) -> Column:
    """A made-up name; later attempts are longer, so there is always a free one."""
    out = F.lit(None).cast("string")
    for (script, sort), ends in ENDINGS.items():
        inside = canonical.rlike("\\p{IsCyrillic}") if script == "cyrillic" else \
            canonical.rlike("\\p{IsGreek}") if script == "greek" else F.lit(True)
        body = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), _syllable(script, h)), "")
        made = F.concat(body, _pick(ends, _byte(h, F.lit(60))))
        match = (kind == sort) & inside
        out = F.when(match & (F.lit(script != "latin")), made).otherwise(
            F.coalesce(out, F.when(match, made)))
    return out


def surrogate(kind: Column, canonical: Column, key: str, attempt: Column, h: Column) -> Column:
    """The surrogate in canonical form, from the blocks of _keyed."""
    whole = _letters(canonical, h, F.lit(0))
    octet = [F.when(F.lit(i == 0), F.pmod(_byte(h, F.lit(i)), F.lit(223)) + 1).otherwise(_byte(h, F.lit(i)))
             for i in range(4)]
    # all but the last digit are drawn; the last makes the number as valid as it was
    stem = F.substring(whole, F.lit(1), F.length(whole) - 1)
    check = F.pmod(F.lit(10) - _luhn(F.concat(stem, F.lit("0"))) + _luhn(canonical), F.lit(10))
    user = F.substring_index(canonical, "@", 1)
    # a form that is crowded grows from the third draw on, so there is always a free one
    extra = F.when(attempt > GROWS_AFTER, F.substring(F.get(h, F.lit(1)), F.lit(1), attempt - GROWS_AFTER)).otherwise("")
    digits, letters = F.translate(extra, "abcdef", "012345"), F.translate(extra, "0123456789", "ghijklmnop")
    host = F.concat(_letters(F.substring_index(canonical, ".", 1), h, F.lit(0)), letters, F.lit(".example.org"))
    lead = F.when(F.length(canonical) > 10, F.length(canonical) - 10).otherwise(0)
    return F.when(kind.isin("surname", "given_f", "given_m"), _name(kind, canonical, h, attempt)) \
        .when(kind == "ip", F.concat_ws(".", *[o.cast("string") for o in octet])) \
        .when(kind == "card", F.concat(stem, check.cast("string"))) \
        .when(kind == "mailbox", F.concat(_letters(user, h, F.lit(0)), letters)) \
        .when(kind == "domain", host) \
        .when(kind == "phone", F.concat(_letters(canonical, h, lead), digits)) \
        .when(kind == "ssn", F.concat(whole, digits)) \
        .when(kind == "ip6", _hex_letters(canonical, h)) \
        .when(kind == "iban", _iban(canonical, _letters(canonical, h, F.lit(2)))) \
        .when((kind == "secret") & canonical.rlike("^[0-9A-Fa-f]+$"), F.when(
            canonical.rlike("[A-F]"), F.upper(_hex(canonical, h))).otherwise(_hex(canonical, h))) \
        .otherwise(F.concat(whole, extra))


def _mod97(text: Column) -> Column:
    """A number modulo 97 in which letters stand for two digits, A for 10."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), F.pmod(a * 10 + c.cast("int"), F.lit(97))).otherwise(
        F.pmod(a * 100 + F.ascii(F.upper(c)) - 55, F.lit(97))))


def _iban(canonical: Column, drawn: Column) -> Column:
    """The drawn account with check digits as valid as they were."""
    body, country = F.substring(drawn, F.lit(5), F.length(drawn)), F.substring(canonical, 1, 2)
    check = F.lpad((F.lit(98) - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.substring(canonical, F.lit(5), F.length(canonical)), F.substring(canonical, 1, 4))) == 1
    return F.when(valid, F.concat(country, check, body)).otherwise(drawn)


def _hex_letters(canonical: Column, h: Column) -> Column:
    """Each hexadecimal digit exchanged for another."""
    return F.array_join(F.transform(F.split(canonical, ""), lambda c, k: F.when(
        c.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), F.lit(1) + F.pmod(_byte(h, k), F.lit(16)), F.lit(1)))
        .otherwise(c)), "")


def _hex(canonical: Column, h: Column) -> Column:
    return F.substring(F.array_join(h, ""), F.lit(1), F.length(canonical))


def _drawn(values: DataFrame, key: str) -> DataFrame:
    """Surrogates of kind, canonical, attempt; hashes are columns, so that no character takes them anew."""
    kind, canonical, attempt = F.col("kind"), F.col("canonical"), F.col("attempt")
    hashed = values.select("kind", "canonical", "attempt", _keyed(kind, canonical, key, attempt).alias("h"))
    return hashed.select("kind", "canonical", "attempt",
                         surrogate(kind, canonical, key, attempt, F.col("h")).alias("made"))


def _dressed(kind: Column, form: Column, made: Column) -> Column:
    """The canonical surrogate with the separators and the case of the mention."""
    named = F.when(form.rlike("^\\p{Lu}+$") & (F.length(form) > 1), F.upper(made)) \
        .otherwise(F.concat(F.upper(F.substring(made, 1, 1)), F.substring(made, F.lit(2), F.length(made))))
    # separators return to their places: the surrogate's characters fill the mention's in order
    chars = F.split(form, "")
    laid = F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), lambda a, c: F.when(
        c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["out"], F.substring(made, a["n"] + 1, F.lit(1))).alias("out"),
                                        (a["n"] + 1).alias("n")))
        .otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n"))),
        # a grown surrogate has more characters than the mention
        lambda a: F.concat(a["out"], F.substring(made, a["n"] + 1, F.length(made))))
    shouted = form.rlike("\\p{Lu}") & ~form.rlike("\\p{Ll}") & (F.length(form) > 1)
    return F.when(kind.isin("surname", "given_f", "given_m"), named) \
        .when(kind.isin("mailbox", "domain", "ip6") & shouted, F.upper(made)) \
        .when(kind.isin("card", "ssn", "iban", "phone"), laid).otherwise(made)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, canonical -> surrogate, all apart within a kind and none a real value of the table.

    A surrogate that is taken, by an earlier draw or the lesser canonical form, or that is
    itself in the table, is drawn again under the next attempt, until none is left. Crowded
    forms grow (GROWS_AFTER), so few draws are enough; after MOST_DRAWS an error says so.
    """
    distinct = written(entities.filter("kind <> 'keep'").select("kind", "canonical").distinct(), "entities")
    now = written(_drawn(distinct.withColumn("attempt", F.lit(0)), key), "surrogates")
    real = distinct.select("kind", F.col("canonical").alias("made"), F.lit(True).alias("real"))
    for _ in range(MOST_DRAWS):
        first = now.groupBy("kind", "made").agg(
            F.min(F.struct("attempt", "canonical"))["canonical"].alias("owner"), F.count(F.lit(1)).alias("k"))
        taken = first.filter("k > 1").select("kind", "made", "owner")
        judged = now.join(taken, ["kind", "made"], "left").join(real, ["kind", "made"], "left").withColumn(
            "again", F.coalesce(F.col("real"), F.lit(False)) | (
                F.col("owner").isNotNull() & (F.col("owner") != F.col("canonical"))))
        judged = written(judged, "surrogates-judged")
        if judged.filter("again").isEmpty():
            return now
        drawn = _drawn(judged.filter("again").withColumn("attempt", F.col("attempt") + 1), key)
        columns = ["kind", "canonical", "attempt", "made"]
        now = written(judged.filter("not again").select(*columns).unionByName(drawn.select(*columns)),
                      "surrogates")
    raise RuntimeError(f"surrogates still meet after {MOST_DRAWS} draws")


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_replaced (mentions) per row.

    Texts are searched whole. A row without a finding keeps its text; null stays null and
    empty stays empty. Repeated rows and equal ids stay, each with the same surrogates;
    empty tables give no rows; other columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = F.when(_cheap(F.col("text")), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    marked = slim.withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    hits = written(marked.filter(F.size("found") > 0).withColumn("row", F.monotonically_increasing_id()),
                   "pii-texts")
    # digits alone do not say whether they were found as a secret
    secret = F.when(F.exists("found", _no_card), F.regexp_extract_all("text", F.lit(ANY), F.lit(1)))
    mentions = hits.select("row", secret.alias("secret"), "found") \
        .select("row", "secret", F.posexplode("found").alias("at", "value"))
    kinds = mentions.select("row", "at", "value", _kind(F.col("value"), F.coalesce(
        F.get("secret", F.col("at")) != "", F.lit(False))).alias("kind"))
    parts = written(kinds.select("row", "at", F.posexplode(_parts(F.col("value"), F.col("kind"))).alias("i", "p"))
                    .select("row", "at", "i", "p.*"), "pii-mentions")
    assigned = assign(parts, key).select("kind", "canonical", "made")
    # one row per value on the right: a value in very many documents may be split by the join
    named = parts.join(assigned, ["kind", "canonical"], "left").withColumn(
        "text", F.coalesce(_dressed(F.col("kind"), F.col("form"), F.col("made")), F.col("form")))
    whole = named.groupBy("row", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("i", "text"))), lambda x: x["text"]), "").alias("value"),
        F.max((F.col("kind") != "keep").cast("bigint")).alias("replaced"))
    values = whole.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("at", "value"))), lambda x: x["value"]).alias("own"), F.sum("replaced").alias("n_replaced"))
    pieces = F.split("text", ANY, -1)
    # a value between each two pieces
    rebuilt = F.array_join(F.flatten(F.transform(F.arrays_zip("pieces", "own"), lambda z: F.array(
        z["pieces"], F.coalesce(z["own"], F.lit(""))))), "")
    changed = hits.join(values, "row").select("doc_id", pieces.alias("pieces"), "own", "n_replaced") \
        .select("doc_id", rebuilt.alias("text"), "n_replaced")
    rest = marked.filter(F.size("found") == 0).select("doc_id", "text", F.lit(0).cast("bigint").alias("n_replaced"))
    return changed.unionByName(rest)
