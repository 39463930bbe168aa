"""Personal data (op 10): surrogate generation, with DataFrame functions only.

Entities are found by patterns: e-mail addresses, telephone and other long numbers, payment cards, bank account
numbers, IP addresses, quoted or prefixed secrets, and names after a title; a name's parts are then found wherever
else they stand in the same text, with or without a title. Names that no title ever introduces are not found. Every
mention is replaced by a keyed surrogate of the same type:

- Numbers keep their format; their digits go through a keyed Feistel cipher over decimal strings, so
  distinct numbers stay distinct by construction. Country codes stay, and a number has one surrogate in whatever format it
  is written. Cards keep their first digit and whether their check digit holds, international bank account numbers their
  country, with new check digits. IPv4 addresses go through a Feistel cipher over 32 bits.
- Secrets and IPv6 addresses keep their length and character classes. E-mail addresses keep the shape of the local part; their domain becomes a keyed one below a reserved domain.
- Names keep their title; given names get one of the same gender and script, surnames one of the same script.

The last two kinds are hashes and can collide, so their distinct values are gathered, the surrogates
compared, and all but the first value of a colliding group tried again with the next salt, until all
surrogates differ. Equal entities (letter case aside) always get equal surrogates, in all texts.
Retried values reach the texts by a join, of which there is none as long as nothing collided.

Cases: null texts stay null, empty ones empty; texts without entities stay as they are. Ties in a
colliding group go by value. Repeated rows are treated alike; an empty table gives an empty result.
All other columns are kept, and names that start with _pii are this operator's own. Rows whose id is
null keep first surrogates even if they collide. Texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored

KEY = "surrogate-key-1"
EMAIL = r"[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.)+\p{L}{2,24}"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)(?![\d]|\.\d)"
SECRET = r"""(?<=(?i:token|secret|password|passwd|api_key|apikey|api-key|access_key)\s{0,3}[=:]\s{0,3}["'])[^"'\s]{8,}|\b(?:(?i:AKIA)[0-9A-Za-z]{16}|(?i:gh[pousr]_)[A-Za-z0-9]{36}|(?i:sk-)[A-Za-z0-9]{20,})\b|(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"""
IPV6 = r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,40}\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?(?=[A-Z0-9]*\d)[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
#: Country calling codes of one and two digits; all others have three.
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
PHONE = r"(?<![\d\p{L}])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d\p{L}+])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d\p{L}-])\d{3}-\d{3}-\d{4}(?![\d-])"
NUMBER = r"(?<![\d\p{L}-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<![\d\p{L}.])\d{4}[ -]\d{6}[ -]\d{5}(?!\d)|(?<![\d\p{L}.])\d{4}(?:[ -]\d{4}){3}(?!\d)|(?<![\d\p{L}.])\d{9,19}(?![\d\p{L}])"
#: Titles by gender; names after a title of no gender take that of the given name.
MALE, FEMALE, NEUTRAL = r"Mr|Herr|Monsieur|Señor|Sr|Sir|г-н|[Гг]осподин", r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Lady|г-жа|[Гг]оспожа", r"Dr|Prof"
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}\p{L}{0,30}(?:[-'’]\p{Lu}\p{L}{1,30}){0,3}"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{MALE}|{FEMALE}|{NEUTRAL})\.? {_WORD}(?: {_WORD})?(?![\p{{L}}\p{{N}}])"
HASHED = f"{EMAIL}|{SECRET}|{IPV6}|{NAME}"
PATTERN = f"{EMAIL}|{SECRET}|{IPV6}|{IPV4}|{IBAN}|{PHONE}|{NUMBER}|{NAME}"
#: Texts without any of these hold no entity.
HINT = rf"[@0-9]|::|[=:]\s{{0,3}}[\"']|(?i:AKIA|gh[pousr]_|sk-)|(?:{MALE}|{FEMALE}|{NEUTRAL})\.? \p{{Lu}}"
GIVEN_MALE = "James Robert John Michael David William Richard Thomas Daniel Matthew Anthony Mark Paul Steven Andrew Peter George Henry Louis Martin Felix Oscar Hugo Simon".split()
GIVEN_FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Anna Laura Julia Emma Clara Alice Helen Irene Sofia Marta Nina Eva".split()
SYLLABLES = "ba be bo ca da de do fa fe ga go ha jo ka ke la le li lo ma me mi mo na ne no pa ra re ro sa se so ta te to va ve vi wa".split()
CYRILLIC_SYLLABLES = "ба ва га да ка ла ма на па ра са та бе ве ле ме не ре бо во ко ло мо но ро со то ви ли ми".split()


def _seed(*parts: Column | str | int) -> Column:
    """A keyed 63-bit number."""
    return F.xxhash64(F.lit(KEY), *[p if isinstance(p, Column) else F.lit(p) for p in parts]).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _power10(n: Column) -> Column:
    """10**n as a whole number, n at most 18."""
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("bigint")


def _feistel_digits(digits: Column, kind: str) -> Column:
    """A keyed bijection on digit strings of each length up to 36."""
    half = F.floor(F.length(digits) / 2).cast("int")
    start = F.struct(F.substring(digits, F.lit(1), half).alias("a"), F.substring(digits, half + 1, F.length(digits)).alias("b"))

    def turn(acc: Column, r: Column) -> Column:
        a, b = acc["a"], acc["b"]
        base = _power10(F.length(a))
        moved = F.pmod(F.coalesce(F.try_to_number(a, F.lit("9" * 18)), F.lit(0)).cast("bigint") + F.pmod(_seed(kind, r, b), base), base).cast("string")
        return F.struct(b.alias("a"), F.when(F.length(a) == 0, a).otherwise(F.lpad(moved, F.length(a), F.lit("0"))).alias("b"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(6)]), start, turn, lambda x: F.concat(x["a"], x["b"]))


def _refill(shape: Column, digits: Column) -> Column:
    """shape, with its digits replaced in order."""
    at = lambda i: F.length(_digits(F.substring(shape, F.lit(1), i + 1)))
    chars = F.split(shape, "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.between("0", "9"), F.substring(digits, at(i), F.lit(1))).otherwise(c)), "")


def _luhn(first: Column) -> Column:
    """The check digit that the digits before it ask for."""
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(
        F.transform(F.split(first, ""), lambda c, i: F.when((F.length(first) - i) % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x
    )
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def _card(digits: Column) -> Column:
    """15 or 16 digits: the first stays, the next are moved, the last keeps its distance to the right check digit."""
    n = F.length(digits)
    moved = F.concat(F.substring(digits, 1, 1), _feistel_digits(F.substring(digits, F.lit(2), n - 2), "card"))
    off = F.pmod(F.substring(digits, n, F.lit(1)).cast("int") - _luhn(F.substring(digits, F.lit(1), n - 1)), F.lit(10))
    return F.concat(moved, F.pmod(_luhn(moved) + off, F.lit(10)).cast("string"))


def _number(m: Column) -> Column:
    """Telephone and other numbers."""
    code = F.regexp_extract(m, CALLING, 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    digits = _digits(rest)
    card = (code == "") & (F.length(digits).isin(16) | m.rlike(r"^\d{4}[ -]\d{6}[ -]\d{5}$"))
    return F.concat(code, _refill(rest, F.when(card, _card(digits)).otherwise(_feistel_digits(digits, "number"))))


def _iban(m: Column) -> Column:
    """The country stays; digits are moved, letters shifted by place, and the check digits follow."""
    body = F.substring(m, F.lit(5), F.length(m))
    shifted = F.array_join(
        F.transform(F.split(body, ""), lambda c, i: F.when(c.between("A", "Z"), F.chr(F.lit(65) + F.pmod(F.ascii(c) - 65 + F.pmod(_seed("iban", i), F.lit(26)), F.lit(26)))).otherwise(c)), ""
    )
    made = _refill(shifted, _feistel_digits(_digits(body), "iban"))
    figures = F.split(F.concat(F.regexp_replace(made, " ", ""), F.substring(m, 1, 2), F.lit("00")), "")
    rest = F.aggregate(
        figures, F.lit(0), lambda acc, c: F.when(c.between("0", "9"), F.pmod(acc * 10 + F.ascii(c) - 48, F.lit(97))).when(c.between("A", "Z"), F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97))).otherwise(acc)
    )
    return F.concat(F.substring(m, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), made)


def _ipv4(m: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    start = F.struct((o[0] * 256 + o[1]).alias("a"), (o[2] * 256 + o[3]).alias("b"))
    turn = lambda acc, r: F.struct(acc["b"].alias("a"), F.pmod(acc["a"] + F.pmod(_seed("ip", r, acc["b"]), F.lit(65536)), F.lit(65536)).cast("int").alias("b"))
    done = lambda x: F.concat_ws(".", F.floor(x["a"] / 256).cast("string"), (x["a"] % 256).cast("string"), F.floor(x["b"] / 256).cast("string"), (x["b"] % 256).cast("string"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(6)]), start, turn, done)


def _classes(value: Column, seed: Column, hexadecimal: Column) -> Column:
    """value with each character replaced by one of its class, chosen by keyed hashes of seed and place."""
    letter = lambda first, i: F.chr(F.lit(first) + F.pmod(_seed("chr", seed, i), F.lit(26)))

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(hexadecimal & c.rlike("[0-9a-f]"), F.lower(F.hex(F.pmod(_seed("hex", seed, i), F.lit(16)))))
            .when(c.between("0", "9"), F.pmod(_seed("dig", seed, i), F.lit(10)).cast("string"))
            .when(c.rlike(r"\p{Lu}"), letter(65, i))
            .when(c.rlike(r"\p{L}"), letter(97, i))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _email(canon: Column, salt: Column) -> Column:
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.regexp_extract(domain, r"\.(com|org|net)$", 1)
    host = F.concat(F.lit("m"), F.translate(F.lower(F.lpad(F.hex(_seed("domain", domain)), 16, "0")), "0123456789", "ghijklmnop"))
    more = F.when(salt > 0, F.concat(F.lit("."), F.translate(F.lower(F.hex(_seed("more", canon, salt))), "0123456789", "ghijklmnop"))).otherwise(F.lit(""))
    return F.concat(_classes(local, _seed("email", canon, salt), F.lit(False)), more, F.lit("@"), host, F.lit(".example."), F.when(top == "", "com").otherwise(top))


def _secret(canon: Column, salt: Column) -> Column:
    return _classes(canon, _seed("secret", canon, salt), canon.rlike("^[0-9a-f:]+$"))


def _syllabic(table: list[str], seed: Column, n: int) -> Column:
    pick = lambda k: F.element_at(F.array(*[F.lit(s) for s in table]), (F.pmod(F.shiftright(seed, 7 * k), F.lit(len(table))) + 1).cast("int"))
    return F.initcap(F.concat(*[pick(k) for k in range(n)]))


def _name_part(canon: Column, salt: Column) -> Column:
    """canon: given:m:anna, given:f:..., given:n:... or surname:...; of the same gender and script."""
    seed = _seed("name", canon, salt)
    choose = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(seed, F.lit(len(names))) + 1).cast("int"))
    tail = F.when(salt == 0, F.lit("")).otherwise(F.concat(F.lit("-"), _syllabic(SYLLABLES, _seed("tail", canon, salt), 3)))
    latin = (
        F.when(canon.startswith("given:f:"), F.concat(choose(GIVEN_FEMALE), tail))
        .when(canon.startswith("given:m:"), F.concat(choose(GIVEN_MALE), tail))
        .when(canon.startswith("given:"), F.concat(choose([*GIVEN_FEMALE, *GIVEN_MALE]), tail))
        .otherwise(_syllabic(SYLLABLES, seed, 4))
    )
    return F.when(canon.rlike(r":[^:]*\p{IsCyrillic}"), _syllabic(CYRILLIC_SYLLABLES, seed, 4)).otherwise(latin)


def _hashed(canon: Column, salt: Column) -> Column:
    """Surrogate of a canonical value of a kind that can collide."""
    value = F.regexp_replace(canon, r"^(?:email|secret):", "")
    return F.when(canon.startswith("email:"), _email(value, salt)).when(canon.startswith("secret:"), _secret(value, salt)).otherwise(_name_part(canon, salt))


def _is_name(m: Column) -> Column:
    return m.rlike(rf"^(?:{MALE}|{FEMALE}|{NEUTRAL})\.? \p{{Lu}}")


def _secret_canon(m: Column) -> Column:
    """Hexadecimal in upper case is the same secret."""
    return F.concat(F.lit("secret:"), F.when(m.rlike("^[0-9A-Fa-f:]+$"), F.lower(m)).otherwise(m))


def _cased(surrogate: Column, m: Column) -> Column:
    """The surrogate of upper-case hexadecimal in upper case."""
    return F.when(m.rlike("^[0-9A-F:]*[A-F][0-9A-F:]*$"), F.upper(surrogate)).otherwise(surrogate)


def _canons(m: Column) -> Column:
    """Canonical values of a mention: one, or given name and surname."""
    words = F.split(F.lower(F.regexp_replace(m, r"^\S+ ", "")), " ")
    title = F.regexp_extract(m, r"^[\p{L}-]+", 0)
    known = lambda names: words[0].isin([x.lower() for x in names])
    gender = (
        F.when(title.rlike(f"^(?:{MALE})$"), "m").when(title.rlike(f"^(?:{FEMALE})$"), "f").when(known(GIVEN_MALE), "m").when(known(GIVEN_FEMALE), "f").otherwise("n")
    )
    name = F.when(F.size(words) > 1, F.array(F.concat(F.lit("given:"), gender, F.lit(":"), words[0]), F.concat(F.lit("surname:"), F.element_at(words, -1)))).otherwise(
        F.array(F.concat(F.lit("surname:"), words[0]))
    )
    return F.when(_is_name(m), name).when(m.contains("@"), F.array(F.concat(F.lit("email:"), F.lower(m)))).otherwise(F.array(_secret_canon(m)))


def _parts(found: Column) -> Column:
    """Map from the words of a text's titled names, as written and in capitals, to their canonical values; of a word with
    several, the least. Distinct mentions only, and sorted, so a text with many names takes no longer than sorting them."""
    words = lambda m: F.split(F.regexp_replace(m, r"^\S+ ", ""), " ")
    entry = lambda w, c: F.array(F.struct(w.alias("key"), c.alias("value")), F.struct(F.upper(w).alias("key"), c.alias("value")))
    mentions = F.array_distinct(F.filter(found, _is_name))
    each = F.array_sort(F.array_distinct(F.flatten(F.flatten(F.transform(mentions, lambda m: F.zip_with(words(m), _canons(m), entry))))))
    # bound once: inside a lambda the sorted array itself would be made for every element
    first = lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["key"] != e["key"]))
    return F.map_from_entries(F.element_at(F.transform(F.array(each), first), 1))


def _replaced(m: Column, retried: Column, parts: Column) -> Column:
    """Surrogate of a mention; retried: map from canonical value to a later surrogate, or null; parts: words of the
    names in the text."""
    kept = lambda c: F.coalesce(F.try_element_at(retried, c), _hashed(c, F.lit(0)))
    title = F.regexp_extract(m, r"^\S+ ", 0)
    part = F.try_element_at(parts, m)
    named = kept(part)
    return (
        F.when(part.isNotNull(), F.when(m == F.upper(m), F.upper(named)).otherwise(named))
        .when(m.contains("@"), kept(F.concat(F.lit("email:"), F.lower(m))))
        .when(_is_name(m), F.concat(title, F.array_join(F.transform(_canons(m), kept), " ")))
        .when(m.rlike(rf"^{IPV4}$"), _ipv4(m))
        .when(m.rlike(rf"^{IBAN}$"), _iban(m))
        .when(m.rlike(rf"^(?:{PHONE}|{NUMBER})$"), _number(m))
        .otherwise(_cased(kept(_secret_canon(m)), m))
    )


def collisions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(id, map of canonical value to surrogate) of the texts with values that had to be tried again; None if there are none."""
    hinted = docs.where(F.col(text_col).rlike(r"@|::|(?:[0-9A-Fa-f]{1,4}:){7}|[=:]\s{0,3}[\"']|[0-9A-Fa-f]{32}|(?i:AKIA|gh[pousr]_|sk-)|(?:" + f"{MALE}|{FEMALE}|{NEUTRAL}" + r")\.? \p{Lu}"))
    mentions = hinted.select(F.col(id_col).alias("_pii_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(HASHED), F.lit(0))).alias("m"))
    mentions = stored(mentions.select("_pii_id", F.explode(_canons(F.col("m"))).alias("canon")).distinct(), "mentions")
    values = mentions.select("canon").distinct()
    kind = F.substring_index(F.col("canon"), ":", 1)
    tried = stored(values.select("canon", kind.alias("kind"), _hashed(F.col("canon"), F.lit(0)).alias("surrogate")), "surrogates")
    first = tried.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"), F.count("*").alias("n"))
    if first.where("n > 1").isEmpty():
        return None
    settled = stored(first.select("kind", "surrogate", "canon"), "settled")
    left, final, salt = stored(tried.join(settled.select("canon"), "canon", "left_anti").select("canon"), "left"), None, 1
    while not left.isEmpty():
        again = left.select("canon", kind.alias("kind"), _hashed(F.col("canon"), F.lit(salt)).alias("surrogate"))
        best = again.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        good = stored(best.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti").select("kind", "surrogate", "canon"), "settled")
        settled, final = settled.unionByName(good), good if final is None else final.unionByName(good)
        left, salt = stored(left.join(good.select("canon"), "canon", "left_anti"), "left"), salt + 1
    found = mentions.join(final, "canon").where(F.col("_pii_id").isNotNull())
    return stored(found.groupBy("_pii_id").agg(F.map_from_entries(F.collect_set(F.struct("canon", "surrogate"))).alias("_pii_retried")), "retried")


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with every entity in text_col replaced; counts adds n_entities. Texts are shuffled only if hashes collided."""
    retried = collisions(docs, id_col, text_col)
    names = docs.columns
    if retried is None:
        rows = docs.withColumn("_pii_retried", F.lit(None).cast("map<string,string>"))
    else:
        rows = docs.join(retried, docs[id_col] == retried["_pii_id"], "left").drop("_pii_id")
    text = F.col(text_col)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_pii_found", F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none))
    # texts with names are searched again for the names' parts
    rows = rows.withColumn("_pii_parts", F.when(F.exists("_pii_found", _is_name), _parts(F.col("_pii_found"))))
    word = F.concat(F.lit(rf"{PATTERN}|(?<![\p{{L}}\p{{N}}])(?:"), F.array_join(F.reverse(F.array_sort(F.map_keys("_pii_parts"))), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    has = F.col("_pii_parts").isNotNull()
    rows = rows.withColumn("_pii_found", F.when(has, F.regexp_extract_all(text, word, F.lit(0))).otherwise(F.col("_pii_found")))
    between = F.when(has, F.split(text, word, -1)).otherwise(F.split(text, PATTERN, -1))
    one = lambda s, m: F.array(s, F.when(m.isNull(), F.lit("")).otherwise(_replaced(m, F.col("_pii_retried"), F.col("_pii_parts"))))
    joined = F.array_join(F.flatten(F.zip_with(between, F.col("_pii_found"), one)), "")
    made = F.when(F.size("_pii_found") > 0, joined).otherwise(text)
    more = [F.coalesce(F.size("_pii_found"), F.lit(0)).cast("bigint").alias("n_entities")] if counts else []
    return rows.select(*[made.alias(c) if c == text_col else F.col(c) for c in names], *more)
