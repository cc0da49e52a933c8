"""Personal data and secrets: detection and keyed surrogates, with DataFrame functions only.

One pattern finds the entities of a text in order. Entities are brought to a canonical form (an address in lower
case, the bare digits of a number, a name without its title), so that mentions of one entity share one surrogate
everywhere. The table of distinct canonical forms gives each a surrogate from a keyed SHA-256: same kind, same
shape (digits for digits, letters for letters, title and case kept, Luhn digits valid), fictional ranges where
there are any. Collision checks run on that table: a surrogate must be new among the surrogates and must not be
an entity of the corpus; who loses draws again. Surnames have a table of their own, from which names are put together.

Equal texts share their replacements: entities are found and joined once per distinct text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialise

KEY = "gridloom-surrogates"  # the default key; a parameter
TRIES = 6

MALE = ["Mr", "Herr", "Monsieur", "Señor", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Госпожа"]
EITHER = ["Dr", "Prof"]
GIVEN = {
    "m": ["Alan", "Bruno", "Carl", "Dario", "Emil", "Felix", "Georg", "Hugo", "Ivo", "Jonas", "Karel", "Leon", "Marco", "Nils", "Oscar", "Paul"],
    "f": ["Alma", "Berta", "Clara", "Diana", "Elena", "Frida", "Greta", "Helga", "Irene", "Julia", "Karla", "Lena", "Maria", "Nora", "Olga", "Paula"],
    "n": ["Alex", "Robin", "Sasha", "Kim", "Noel", "Jules", "Andrea", "Dominique", "Toni", "Mika", "Charlie", "Sam", "Jamie", "Morgan", "Quinn", "Rene"],
}
GIVEN_CYRILLIC = {
    "m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    "f": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"],
    "n": ["Саша", "Женя", "Валя", "Слава", "Шура", "Никита", "Паша", "Юля"],
}
SYLLABLES = ["ba", "cor", "del", "fen", "gar", "hol", "kim", "lan", "mor", "nel", "par", "ros", "sel", "tam", "vor", "wen"]
SYLLABLES_CYRILLIC = ["бар", "вол", "гор", "дем", "зав", "ков", "лан", "мир", "нов", "пет", "рож", "сав", "тим", "фед", "хар", "чер"]

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
LABEL = r"[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+"
EMAIL = rf"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?=[A-Za-z0-9.\-]*[A-Za-z]{{2}}){LABEL}(?:\.{LABEL})++"
CLOUD_KEY = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:sk|ghp|gho|ghs|xoxb|xoxp)[-_][A-Za-z0-9_\-]{16,}+"
SECRET_WORD = r"(?i:password|passwd|pwd|token|secret|api[_\-]?key|access[_\-]?key)"
#: After "=" any value of 8 characters; after ":", where a word of prose may stand, one with a digit, a mark inside or capitals after small letters.
VALUE = r"(?=[\"']?(?:[A-Za-z+/_.=\-]*+\d|[A-Za-z.\-]++[+/_=][A-Za-z]|[A-Z]*+[a-z\-]++[A-Z]))"
SECRET = rf"\b{SECRET_WORD}\s*+(?:=\s*+|:\s*+{VALUE})[\"']?[A-Za-z0-9+/_.=\-]{{8,}}(?<!\.)[\"']?"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
PHONE = r"(?<![\w+])\+\d(?:[ .\-/()]{0,2}+\d){7,14}+(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = r"(?<![\d.\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?![\d\-])"
ABBREVIATED = ["Mr", "Mrs", "Ms", *EITHER]
#: As they are written, in capitals, and in small letters but for "miss", which is a verb too.
TITLES = "|".join(dict.fromkeys(f(t) for f in (str, str.upper, str.lower) for t in [*MALE, *FEMALE, *EITHER] if f is not str.lower or t != "Miss"))
GAP = "[ \u00a0]"
#: Words that stand before a surname and are no part of it.
PARTICLES = "von|vom|zu|zur|zum|van|der|den|ter|ten|de|del|della|di|da|dos|das|du|la|le|las|los"
PART = rf"(?:(?:{PARTICLES}){GAP})*+(?:\p{{Lu}}\.?(?={GAP}\p{{Lu}})|\p{{Lu}}\p{{L}}*+(?:(?!['’][sS](?!\p{{L}}))['’\-]\p{{L}}++)*+(?<=\p{{L}}[\p{{L}}'’\-]))"
NAME = rf"(?<!\p{{L}})(?:{TITLES})\.?{GAP}{PART}(?:{GAP}{PART})*+"
ENTITY = "|".join([EMAIL, CLOUD_KEY, SECRET, IP, PHONE, SSN, CARD, NAME])
#: What every entity has one of: lets most texts go by after one quick scan.
MAYBE = rf"[0-9@]|\b{SECRET_WORD}\s*+[=:]|\b(?:sk|gh[pos]|xox[bp])[-_]|\bA[KS]IA[A-Z]|(?<!\p{{L}})(?:{TITLES})\.?[  ]"


def luhn(digits: Column) -> Column:
    """Whether the last digit checks the others."""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + _luhn_term(F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1))
    return total % 10 == 0


def _luhn_term(digit: Column, doubled: Column) -> Column:
    return F.when(doubled, digit * 2 - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def kind(entity: Column) -> Column:
    return (
        F.when(entity.rlike(rf"^{SECRET_WORD}\s*[=:]"), "secret").when(entity.rlike("^[^@ ]+@[^@ ]+$"), "email").when(entity.rlike(rf"^(?:{CLOUD_KEY})$"), "key")
        .when(entity.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip").when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(entity.rlike(r"^[+(]|^\d{3}[.\-]\d{3}[.\-]\d{4}$"), "phone").when(entity.rlike(r"^\d"), "card").otherwise("name")
    )


def canonical(entity: Column, k: Column) -> Column:
    """The same for all mentions of an entity. A name is its title's gender, a bar and its words, without particles, in small letters."""
    title = F.lower(F.regexp_extract(entity, rf"^({TITLES})\.?{GAP}", 1))
    gender = F.when(title.isin([t.lower() for t in MALE]), "m").when(title.isin([t.lower() for t in FEMALE]), "f").otherwise("n")
    name = F.regexp_replace(F.regexp_replace(entity, rf"^(?:{TITLES})\.?{GAP}", ""), rf"(?<!\p{{L}})(?:{PARTICLES}){GAP}", "")
    words = F.regexp_replace(F.lower(name), f"{GAP}", " ")
    phone = F.concat(F.when(entity.startswith("+"), "+").otherwise(""), _digits(entity))
    return F.when(k == "email", F.lower(entity)).when(k == "phone", phone).when(k.isin("ssn", "card"), _digits(entity)).when(k == "name", F.concat_ws("|", gender, words)).otherwise(entity)


def entities(text: Column) -> Column:
    """A text's entities in order. Card numbers are told from other long numbers when they are replaced, by their Luhn digit."""
    return F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _draw(stream: Column, i: Column) -> Column:
    """The i-th number from 0 to 255 of a hexadecimal stream of 128 letters."""
    return F.conv(F.substring(stream, ((i - 1) % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(items: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), number % len(items) + 1)


def _like(text: Column, stream: Column, only_hex: Column) -> Column:
    """Letters for letters and digits for digits."""

    def one(ch: Column, i: Column) -> Column:
        v = _draw(stream, i + 1)
        span = F.when(only_hex, 6).otherwise(26)
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), v % span + 1, F.lit(1))
        return F.when(ch.rlike("[0-9]"), (v % 10).cast("string")).when(ch.rlike("[a-z]"), letter).when(ch.rlike("[A-Z]"), F.upper(letter)).otherwise(ch)

    return F.array_join(F.transform(F.split(text, ""), one), "")


#: Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def surrogate(k: Column, form: Column, stream: Column, attempt: int = 0) -> Column:
    """The surrogate of a canonical form, in canonical form."""
    digits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: (_draw(stream, i) % 10).cast("string")), "")
    n = F.length(form)
    local, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    no = F.lit(False)
    email = F.concat(_like(local, stream, no), F.lit("@mail-"), F.substring(stream, 97, 8), F.lit(".example."), F.when(domain.endswith("net"), "net").when(domain.endswith("org"), "org").otherwise("com"))
    area = F.concat((_draw(stream, F.lit(40)) % 8 + 2).cast("string"), F.substring(digits, 1, 2))
    code = F.regexp_extract(form, COUNTRY, 0)
    own = n - F.length(code)
    phone = F.concat(code, F.when(own >= 10, F.concat(F.substring(digits, F.lit(10), own - 10), area, F.lit("555"), F.substring(digits, 3, 4))).otherwise(F.substring(digits, F.lit(1), own)))
    ssn = F.concat(F.lit("9"), F.substring(digits, 1, 8))
    body = F.concat(F.substring(form, 1, 1), F.substring(digits, F.lit(1), n - 2))
    odd = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda acc, i: acc + _luhn_term(F.substring(body, i, F.lit(1)).cast("int"), (n - i) % 2 == 1))
    card = F.concat(body, ((10 - odd % 10) % 10).cast("string"))
    ip = F.concat_ws(".", F.lit("10"), *(_draw(stream, F.lit(i)).cast("string") for i in (1, 2, 3)))
    prefix = F.regexp_extract(form, rf"^({SECRET_WORD}\s*[=:]\s*[\"']?|AKIA|ASIA|(?:sk|ghp|gho|ghs|xoxb|xoxp)[-_])", 1)
    value = F.substring(form, F.length(prefix) + 1, n)
    hidden = F.concat(prefix, _like(value, stream, value.rlike("^[0-9a-f]+[\"']?$")))
    return F.when(k == "email", email).when(k == "phone", phone).when(k == "ssn", ssn).when(k == "card", card).when(k == "ip", ip).when(k == "surname", _surname(form, stream, attempt)).otherwise(hidden)


def _surname(form: Column, stream: Column, attempt: int) -> Column:
    """A word of syllables in the script of the form, of four syllables and two more at each further attempt."""
    at = [_draw(stream, F.lit(i)) for i in range(1, 5 + 2 * attempt)]
    return F.when(form.rlike(r"\p{IsCyrillic}"), F.concat(*(_pick(SYLLABLES_CYRILLIC, i) for i in at))).otherwise(F.concat(*(_pick(SYLLABLES, i) for i in at)))


def _given(gender: Column, form: Column, number: Column) -> Column:
    """The number-th given name of a gender and script, from 0: the list's own, then two joined, then three."""
    out = F.lit("")
    for g in "mfn":
        for script, names in ((False, GIVEN[g]), (True, GIVEN_CYRILLIC[g])):
            n = len(names)
            more = lambda left, names=names, n=n: _pick(names, F.pmod(left, F.lit(n)).cast("int"))
            first, second, third = number, F.floor(number / n) - 1, F.floor((F.floor(number / n) - 1) / n) - 1
            name = F.concat(more(first), F.when(second >= 0, F.concat(F.lit("-"), more(second))).otherwise(""), F.when(third >= 0, F.concat(F.lit("-"), more(third), F.when(third >= n, F.floor(third / n).cast("string")).otherwise(""))).otherwise(""))
            out = F.when((gender == g) & (form.rlike(r"\p{IsCyrillic}") == F.lit(script)), name).otherwise(out)
    return F.lower(out)


def streams(k: Column, form: Column, key: str, attempt: int) -> Column:
    """128 keyed hexadecimal letters."""
    one = F.sha2(F.concat_ws("|", F.lit(key), k, form, F.lit(str(attempt))), 256)
    two = F.sha2(F.concat_ws("|", F.lit(key), form, k, F.lit(str(attempt))), 256)
    return F.concat(one, two)


def surrogate_table(forms: DataFrame, key: str = KEY) -> DataFrame:
    """kind, form, surrogate of distinct (kind, form): no two forms of a kind share one, and none is itself a form.

    Surnames are drawn first, as a table of words without gender or given name, so that a surname meets itself in every
    mention. A name is put together from its surname's surrogate and, if it has a given name, one of the same gender and
    script: the given names that stand with one surname and gender are numbered in the order of their keyed hashes, so no
    two of them share a surrogate.
    """
    forms = materialise(forms.select("kind", "form"), "forms")
    names = forms.where("kind = 'name'").select("form", F.substring("form", 1, 1).alias("gender"), F.split(F.expr("substring(form, 3)"), "[  ]").alias("words"))
    names = names.withColumn("surname", F.element_at("words", -1))
    table = _drawn(forms.where("kind <> 'name'").union(names.select(F.lit("surname"), "surname").distinct()), key)
    beside = Window.partitionBy("gender", "surname", F.size("words") > 1).orderBy(F.sha2(F.concat_ws("|", F.lit(key), F.array_join(F.slice("words", 1, F.size("words") - 1), " ")), 256), "form")
    numbered = names.withColumn("number", F.row_number().over(beside) - 1)
    drawn = table.where("kind = 'surname'").select(F.col("form").alias("surname"), F.col("surrogate").alias("new"))
    given = F.when(F.size("words") > 1, F.concat(_given(F.col("gender"), F.col("form"), F.col("number")), F.lit(" "))).otherwise("")
    composed = numbered.join(drawn, "surname").select(F.lit("name").alias("kind"), "form", F.concat("gender", F.lit("|"), given, "new").alias("surrogate"))
    return table.where("kind <> 'surname'").union(composed)


def _drawn(forms: DataFrame, key: str) -> DataFrame:
    """kind, form, surrogate of distinct (kind, form). Forms that collide draw again, TRIES times; whatever still collides then (a kind whose space is used up) gets its kind and 128 bits of its keyed hash, which is unique."""
    forms = materialise(forms, "drawn")
    taken, pending = None, forms
    for attempt in range(TRIES):
        drawn = pending.withColumn("stream", streams(F.col("kind"), F.col("form"), key, attempt)).withColumn("surrogate", surrogate(F.col("kind"), F.col("form"), F.col("stream"), attempt))
        won = drawn.groupBy("kind", "surrogate").agg(F.min("form").alias("form"))
        won = won.join(forms.withColumnRenamed("form", "surrogate"), ["kind", "surrogate"], "left_anti")
        if taken is not None:
            won = won.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = materialise(won.select("kind", "form", "surrogate"), "surrogates")
        taken = won if taken is None else taken.union(won)
        pending = pending.join(won, ["kind", "form"], "left_anti")
        if pending.isEmpty():
            return taken
        pending = materialise(pending, "pending")
    tag = F.concat(F.lit("["), F.upper("kind"), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), "kind", "form"), 256), 1, 32), F.lit("]"))
    return taken.union(pending.select("kind", "form", tag.alias("surrogate")))


def written(entity: Column, k: Column, new: Column) -> Column:
    """The surrogate in the format of the mention."""
    filled = F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: F.when(F.substring(entity, i, F.lit(1)).rlike("[0-9]"), F.substring(_digits(new), F.length(_digits(F.substring(entity, F.lit(1), i))), F.lit(1))).otherwise(F.substring(entity, i, F.lit(1)))), "")
    title = F.regexp_extract(entity, rf"^((?:{TITLES})\.?[  ])", 1)
    rest = F.substring(entity, F.length(title) + 1, F.length(entity))
    name = F.array_join(F.transform(F.split(F.expr("substring(surrogate, 3)"), "-"), F.initcap), "-")
    named = F.concat(title, F.when((rest == F.upper(rest)) & (F.length(rest) > 1), F.upper(name)).otherwise(name))
    mail = F.when(entity == F.upper(entity), F.upper(new)).otherwise(new)
    return F.when(new.startswith("["), new).when(k.isin("phone", "ssn", "card"), filled).when(k == "name", named).when(k == "email", mail).otherwise(new)


def one_gender(forms: DataFrame) -> DataFrame:
    """kind, form, own of distinct (kind, form): own is the form, but for a full name without a gender that other mentions give one: then it is theirs."""
    name = F.substring("form", 3, 1 << 20)
    full = forms.where("kind = 'name'").select("kind", "form", F.substring("form", 1, 1).alias("gender"), name.alias("name")).where(F.col("name").contains(" "))
    known = full.where("gender <> 'n'").groupBy("name").agg(F.min("gender").alias("own_gender"), F.max("gender").alias("other")).where("own_gender = other").select("name", "own_gender")
    told = full.where("gender = 'n'").join(known, "name").select("kind", "form", F.concat("own_gender", F.lit("|"), "name").alias("own"))
    return forms.select("kind", "form").join(told, ["kind", "form"], "left").select("kind", "form", F.coalesce("own", "form").alias("own"))


def replaced(docs: DataFrame, key: str = KEY, count: str | None = "n_entities") -> DataFrame:
    """docs with surrogates in text, and how many were replaced in a column named by count (none if it is None; it takes the
    place of a column of that name); other columns as they were.

    Null and empty texts stay as they are; repeated rows are replaced alike; an empty table gives none. Numbers of
    card length whose Luhn digit is wrong stay. The surrogates depend on the key and on the set of entities only. The last
    word of a name is its surname. A full name with a title of either gender has the gender of its other mentions, if they
    agree. The pattern runs twice over a text, once to find and once to cut; the pieces are written, so that nothing is
    searched again when surrogates are known.
    """
    columns = [c for c in docs.columns if c != count]
    names = [f"gridloom_{i}" for i in range(len(columns))]
    text = names[columns.index("text")]
    docs = docs.select(*columns).toDF(*names)
    found = docs.withColumn("digest", F.md5(text)).withColumn("found", entities(F.col(text)))
    cut = F.when(F.size("found") > 0, F.split(F.col(text), ENTITY, -1))
    kept = materialise(found.withColumn("gaps", cut).withColumn(text, F.when(F.col("gaps").isNull(), F.col(text))), "cut")
    some = kept.where("gaps is not null")
    distinct = some.groupBy("digest").agg(F.first("found").alias("found"))
    mentions = distinct.select("digest", F.posexplode("found").alias("pos", "entity")).withColumn("kind", kind(F.col("entity"))).withColumn("form", canonical(F.col("entity"), F.col("kind")))
    mentions = materialise(mentions, "mentions")
    real = (F.col("kind") != "card") | luhn(F.col("form"))
    forms = one_gender(materialise(mentions.where(real).select("kind", "form").distinct(), "mentioned"))
    table = surrogate_table(forms.select("kind", F.col("own").alias("form")).distinct(), key).withColumnRenamed("form", "own")
    table = forms.join(table, ["kind", "own"]).select("kind", "form", "surrogate")
    new = F.when(F.col("surrogate").isNull(), F.col("entity")).otherwise(written(F.col("entity"), F.col("kind"), F.col("surrogate")))
    by_text = (
        mentions.join(table, ["kind", "form"], "left").select("digest", F.struct("pos", new.alias("new"), F.col("surrogate").isNotNull().alias("hit")).alias("x"))
        .groupBy("digest").agg(F.array_sort(F.collect_list("x")).alias("news"))
    )
    rebuilt = F.array_join(F.transform(F.arrays_zip("gaps", F.col("news").alias("new")), lambda z: F.concat(z["gaps"], F.coalesce(z["new"]["new"], F.lit("")))), "")
    hits = F.size(F.filter("news", lambda x: x["hit"])).cast("long")
    changed = some.join(by_text, "digest").withColumn(text, rebuilt).withColumn("n_hits", hits)
    plain = kept.where("gaps is null").withColumn("n_hits", F.lit(0).cast("long"))
    both = plain.select(*names, "n_hits").union(changed.select(*names, "n_hits"))
    return both.toDF(*columns, count) if count else both.select(*names).toDF(*columns)
