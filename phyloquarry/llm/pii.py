"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

One scan finds candidates; each is validated (Luhn sum, octets, calendar, number ranges) and what passes is
permuted within its own format by a keyed Feistel network, so that equal values get equal pseudonyms in every
document and different values never the same, as each notation is a domain of its own:

* card numbers: the digits before the check digit are permuted and the check digit is made anew, so a pseudonym
  passes the Luhn test as well; grouping is kept and does not matter for the link;
* phone numbers: the digits after the country code; national identity numbers (ddd-dd-dddd): all digits, walking
  the cycle until the number is a possible one;
* IPv4 addresses without leading zeros: the 32-bit value;
* dates: the day number within 1800-2199, whose 146,097 days are 189 x 773, in the date's own notation. A date
  with slashes is read as month/day where it can be; the others, day/month with a day above 12, are permuted among
  themselves by walking the cycle until the day is above 12 again;
* e-mail addresses (the part before @) and secrets (access key ids; values assigned to password, token, api-key and
  the like): each digit stays a digit, each ASCII letter a letter of its case, all else as it is. A quoted value ends at
  its quote, another at white space, a quote or an angle bracket; it has 4 characters or more. After a colon, unless
  quoted or a password, it also has a digit or 12 characters, as words follow colons in plain text.

International bank account numbers (IBAN), phone numbers without a country code that aren't in the North American
form, and names of persons are no candidates.

Values that are not valid, and dates outside the span, stay as they are; no pseudonym is equal to one of those. A
walk stops after WALK steps, which fewer than one value in 10**25 needs; its last step is taken then, which is
still different from every other pseudonym of the notation.

Round functions take SHA-512 over key, kind, round and the other half. Whoever holds the key can invert the
permutation, nobody else can; it has no default. The key reaches the tasks as the one row of a table, so that it stands
in no plan, web page or event log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The setting that holds the key, and the key of the queries over the invented test tables, which is no secret.
KEY_SETTING, DEMO_KEY = "spark.phyloquarry.pseudonymKey", "a published key protects nobody"
ROUNDS, WALK = 8, 64

#: Candidates by kind, in order of preference where several begin at one place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
PASSWORD, OTHER_SECRET = r"[Pp]ass(?:word|wd|phrase)|PASS(?:WORD|WD|PHRASE)", r"[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY"
NAME = r"(?<![A-Za-z0-9])(?:[A-Za-z]{1,16}[_-]){0,2}"
AFTER_NAME = r"(?:[_-][A-Za-z]{1,16}){0,2}[\"']?[ ]{0,2}"
QUOTED, BARE = r"(?:\"[^\"\n]{4,}+(?=\")|'[^'\n]{4,}+(?='))", r"[^\s\"'<>]"
ASSIGNED = (
    NAME + "(?:(?:" + PASSWORD + ")" + AFTER_NAME + "[=:][ ]{0,2}(?:" + QUOTED + "|" + BARE + "{4,}+)"
    "|(?:" + OTHER_SECRET + ")" + AFTER_NAME + "(?:=[ ]{0,2}(?:" + QUOTED + "|" + BARE + "{4,}+)"
    "|:[ ]{0,2}(?:" + QUOTED + "|" + BARE + "{12,}+|(?=[^\\s\"'<>0-9]{0,10}[0-9])" + BARE + "{4,}+)))"
)
#: What stands before the value itself.
BEFORE_SECRET = r"^[^=:]*[=:][ ]{0,2}[\"']?"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)"
ISO_DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2})(?![\w/-])"
DAY_DATE = r"(?<![\w/.-])(?:\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{8,15}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
CARD = r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:(?: \d{4}){2} \d{1,7}|(?:-\d{4}){2}-\d{1,7}|[ -]\d{6}[ -]\d{5}))(?![\w-])"
ANY = "|".join([EMAIL, ACCESS_KEY, ASSIGNED, IP, ISO_DATE, DAY_DATE, SSN, PHONE, CARD])

#: The calendar span that dates are permuted in: 400 years, 189 x 773 days.
FIRST_DAY, WEEKS, DAYS = "1800-01-01", 189, 773


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used: a lambda over one element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def draw(key: Column, kind: str, turn: Column, half: Column) -> Column:
    """128 hexadecimal digits from the keyed round function."""
    return F.sha2(F.concat(key, F.lit(f"|{kind}|"), turn.cast("string"), F.lit("|"), half.cast("string")), 512)


def number(digest: Column, modulus: int) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % modulus


def shifted(half: Column, digest: Column) -> Column:
    """Each ASCII letter or digit of ``half`` moved within its class by three hexadecimal digits of the digest."""

    def one(c: Column, i: Column) -> Column:
        step = F.conv(F.substr(digest, i % 42 * 3 + 1, F.lit(3)), 16, 10).cast("int")
        code = F.ascii(c)
        moved = lambda first, size: F.char(F.lit(first) + (code - first + step) % size)
        return F.when(code.between(48, 57), moved(48, 10)).when(code.between(97, 122), moved(97, 26)).when(code.between(65, 90), moved(65, 26)).otherwise(c)

    return F.when(F.length(half) > 0, F.array_join(F.transform(F.split(half, ""), one), "")).otherwise(half)


def permuted(value: Column, key: Column, kind: str) -> Column:
    """The Feistel permutation of strings with the same pattern of classes."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), cut).alias("l"), F.substr(value, cut + 1, F.length(value)).alias("r"))
    turn = lambda s, i: F.struct(s["r"].alias("l"), let(draw(key, kind, i, s["r"]), lambda x: shifted(s["l"], x)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def permuted_pair(a: Column, b: Column, m: int, n: int, key: Column, kind: str) -> Column:
    """The Feistel permutation of pairs (a < m, b < n), as a struct (l, r)."""
    turn = lambda s, i: F.struct(((s["l"] + number(draw(key, kind + "l", i, s["r"]), m)) % m).alias("l"), s["r"].alias("r"))
    back = lambda s, i: F.struct(s["l"].alias("l"), ((s["r"] + number(draw(key, kind + "r", i, s["l"]), n)) % n).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("l"), b.cast("long").alias("r")), lambda s, i: F.when(i % 2 == 1, turn(s, i)).otherwise(back(s, i)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def refilled(shape: Column, new_digits: Column) -> Column:
    """``shape`` (digits, blanks, dots, hyphens, brackets, plus) with its digits replaced in order."""

    def fill(new: Column) -> Column:
        place = lambda i: F.length(F.translate(F.substr(shape, F.lit(1), i), "+ .()-", ""))
        one = lambda i: F.when(F.substr(shape, i, F.lit(1)).between("0", "9"), F.substr(new, place(i), F.lit(1))).otherwise(F.substr(shape, i, F.lit(1)))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")

    return let(new_digits, fill)


def luhn_sum(body: Column) -> Column:
    """The Luhn sum of the digits before a check digit."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(body, F.length(body) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), add)


def check_digit(body: Column) -> Column:
    return ((10 - luhn_sum(body) % 10) % 10).cast("string")


def octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda x: x.cast("int"))


def possible_ssn(d: Column) -> Column:
    """Whether nine digits can be an identity number."""
    area = F.substring(d, 1, 3)
    return ~area.isin("000", "666") & (F.substring(d, 1, 1) != "9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def pseudonym(value: Column, key: Column) -> Column:
    """The pseudonym of a candidate, or the candidate itself if it is not valid."""
    with_check = lambda body: F.concat(body, check_digit(body))
    new_card = lambda d: let(F.substr(d, F.lit(1), F.length(d) - 1), lambda body: F.when(with_check(body) == d, refilled(value, let(permuted(body, key, "card"), with_check))).otherwise(value))
    card = let(digits(value), new_card)
    prefix = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0)
    national = F.substr(value, F.length(prefix) + 1, F.length(value))
    phone = F.concat(prefix, let(national, lambda x: refilled(x, let(digits(x), lambda y: permuted(y, key, "phone")))))
    walk = lambda step, good, x: F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), step(x), lambda y, _: F.when(good(y), y).otherwise(step(y)))
    ssn = let(digits(value), lambda d: F.when(possible_ssn(d), refilled(value, walk(lambda x: permuted(x, key, "ssn"), possible_ssn, d))).otherwise(value))
    to_ip = lambda p: F.concat_ws(".", F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)
    new_ip = lambda o: F.when(F.forall(o, lambda x: x <= 255), let(permuted_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip"), to_ip)).otherwise(value)
    ip = F.when(value.rlike(r"(?:^|\.)0\d"), value).otherwise(let(octets(value), new_ip))
    day_of = lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS + p["r"]).cast("int"))
    next_day = lambda p: permuted_pair(p["l"], p["r"], WEEKS, DAYS, key, "date")

    def date(pattern: str, good=None) -> Column:
        """The date moved, or null if it isn't one of this pattern; ``good`` says which dates the pattern stands for."""
        halves = lambda day: F.struct(F.floor(day / DAYS).cast("long").alias("l"), (day % DAYS).cast("long").alias("r"))
        moved = (lambda p: next_day(p)) if good is None else (lambda p: walk(next_day, good, p))
        new_day = lambda day: F.when(day.between(0, WEEKS * DAYS - 1), let(let(halves(day), moved), lambda p: F.date_format(day_of(p), pattern)))
        return let(F.datediff(F.try_to_timestamp(value, F.lit(pattern)).cast("date"), F.lit(FIRST_DAY).cast("date")), new_day)

    at = F.instr(value, "@")
    email = F.concat(let(F.substr(value, F.lit(1), at - 1), lambda x: permuted(x, key, "email")), F.substr(value, at, F.length(value)))
    secret = let(F.regexp_extract(value, BEFORE_SECRET, 0), lambda x: F.concat(x, let(F.substr(value, F.length(x) + 1, F.length(value)), lambda y: permuted(y, key, "secret"))))
    access = F.concat(F.substring(value, 1, 4), let(F.substr(value, F.lit(5), F.lit(16)), lambda x: permuted(x, key, "access")))
    return (
        F.when(at > 0, email)
        .when(value.rlike(whole(ACCESS_KEY)), access)
        .when(value.rlike("[=:]"), secret)
        .when(value.rlike(whole(IP)), ip)
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.coalesce(date("yyyy-MM-dd"), value))
        .when(value.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.coalesce(date("yyyy/MM/dd"), value))
        .when(value.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.coalesce(date("dd.MM.yyyy"), value))
        .when(value.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.when(value.substr(1, 2) <= "12", F.coalesce(date("MM/dd/yyyy"), value)).otherwise(F.coalesce(date("dd/MM/yyyy", lambda p: F.dayofmonth(day_of(p)) > 12), value)))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), ssn)
        .when(value.rlike(r"^\d{13,19}$|^\d{4}[ -]\d{4,6}[ -]"), card)
        .otherwise(phone)
    )


def pseudonym_key(spark: SparkSession) -> str:
    """The key in the session's setting KEY_SETTING; an error if there is none."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"Pseudonyms need a key: set {KEY_SETTING}")
    return key


def query_key(spark: SparkSession) -> str:
    """The set key or DEMO_KEY: for the queries over the invented test tables, and nothing else."""
    return spark.conf.get(KEY_SETTING, None) or DEMO_KEY


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by pseudonyms, and ``n_private``, the values replaced.

    All other columns are kept (one named ``n_private`` is replaced). A null text stays null with 0, an empty text
    and one without valid values stay as they are, character by character; long texts are taken whole. Repeated
    rows stay rows; an empty table gives none.
    """
    if not key:
        raise ValueError("Pseudonyms need a key")
    names = [c for c in docs.columns if c.lower() != "n_private"]
    text = F.col(f"own_{text_col}")
    maybe = text.rlike("[0-9@=:]") | text.contains("AKIA") | text.contains("ASIA")
    own = docs.select(*[F.col(f"`{c}`").alias(f"own_{c}") for c in names])
    held = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    step = own.withColumn("held_key", held).withColumn("found", F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    step = step.withColumn("new", F.transform("found", lambda m: pseudonym(m, F.col("held_key"))))
    pieces = F.zip_with(F.split(text, ANY, -1), F.concat("new", F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    changed = F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x))
    has = F.coalesce(F.size("new"), F.lit(-1)) > 0
    return step.select(
        *[F.when(has, F.array_join(pieces, "")).otherwise(text).alias(c) if c == text_col else F.col(f"`own_{c}`").alias(c) for c in names],
        F.when(has, changed).otherwise(0).cast("long").alias("n_private"),
    )


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with pseudonyms in place of personal data."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), query_key(spark))


QUERIES = {"op1_feistel_pseudonyms": (op1_feistel_pseudonyms, None)}
