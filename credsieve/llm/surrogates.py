"""PII surrogates: keyed, type-consistent replacements that stay distinct and coreferent.

Entities are found by patterns. Mentions of one entity (an email in other case, a number
in another layout) share a canonical form; the canonical form gets one surrogate from a
keyed digest, and every mention takes the surrogate's letters and digits in its own
layout and case. Surrogates that equal a real entity or another surrogate are drawn again.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import fresh, key_bitmaps, keyed, read, spread, with_likely, written

#: Titles that precede a person's name, by the gender they tell.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
NEUTRAL_TITLES = ("Dr", "Prof", "Доктор")
_SPELT = {x for title in MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES for x in (title, title.upper())}
_TITLES = "|".join(sorted(_SPELT, key=lambda title: (-len(title), title)))

#: (type, pattern), the first that fits a mention names its type. Every pattern is entered
#: at the start of a run of its characters only, so long runs cost linear time.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"),
    (
        "person",
        rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}\p{{L}}++(?:[ -]\p{{Lu}}\p{{L}}++){{0,2}}",
    ),
    ("mac", r"(?<![\p{L}\p{N}:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![\p{L}\p{N}:])"),
    (
        "ipv6",
        r"(?<![\p{L}\p{N}:.])(?=[A-Fa-f:]*+[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
        r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"
        r"|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![\p{L}\p{N}:])",
    ),
    (
        "ip",
        r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|\d{1,2})\.){3}"
        r"(?:25[0-5]|2[0-4]\d|1\d\d|\d{1,2})(?!\d|\.\d)",
    ),
    ("key", r"(?<![\p{L}\p{N}])(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}(?![\p{L}\p{N}])"),
    ("token", r"(?<![\p{L}\p{N}])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{32,64}(?![\p{L}\p{N}])"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("ssn", r"(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])"),
    ("card", r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)"),
    ("phone", r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)"),
    ("phone", r"(?<![\p{L}\p{N}])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"),
    ("phone", r"(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{N}-]|\.\d)"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: Texts without any of these hold no entity; a cheap test before the patterns.
HINT = rf"[\d@]|(?:{_TITLES})\.? "

#: Syllables of surrogate names by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ga ge go ka ke ki ko la le li lo ma me mi mo na ne ni no "
    "pa pe pi po ra re ri ro sa se si so ta te ti to va ve vi vo",
    "cyrillic": "ба бе би бо ва ве ви во га го да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но "
    "па пе пи по ра ре ри ро са се си со та те ти то",
}
#: Last letters of a surrogate's first name, by script, for (male, female).
ENDINGS = {"latin": ("n", "a"), "cyrillic": ("н", "а")}
MAX_ROUNDS = 40
#: After so many rounds, surrogates grow by one letter, digit or syllable a round.
WIDEN_AFTER = 10
DEFAULT_KEY = "credsieve"


def mentions_in(text):
    """All entity mentions of a text, in order."""
    none = F.array().cast("array<string>")
    return F.coalesce(
        F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))), none
    )


def kind_of(mention):
    column = None
    for name, pattern in PATTERNS:
        fits = mention.rlike(f"^(?:{pattern})$")
        column = F.when(fits, name) if column is None else column.when(fits, name)
    return column.otherwise("email")


def canonical_of(kind, mention):
    """What all mentions of an entity share: digits, letters in lower case, the name."""
    name = F.regexp_replace(mention, rf"^(?:{_TITLES})\.? ", "")
    title = F.regexp_extract(mention, rf"^({_TITLES})", 1)
    gender = (
        F.when(F.upper(title).isin(*[t.upper() for t in FEMALE_TITLES]), "f")
        .when(F.upper(title).isin(*[t.upper() for t in NEUTRAL_TITLES]), "n")
        .otherwise("m")
    )
    return (
        F.when(kind == "person", F.concat(gender, F.lit(" "), F.lower(name)))
        .when(kind.isin("email", "ip", "ipv6", "mac"), F.lower(mention))
        .otherwise(F.lower(F.regexp_replace(mention, r"[^\p{L}\p{N}]", "")))
    )


def _digest(key, *parts):
    """512 hex digits from the key and the parts; ``parts`` are columns."""
    seed = F.concat_ws("\u0001", F.lit(key), *parts)
    return F.concat(*[F.sha2(F.concat_ws("\u0002", F.lit(str(n)), seed), 512) for n in range(4)])


def _number(digest, at):
    """Byte number ``at`` (from 0, cyclic) of a digest."""
    place = F.pmod(at, F.lit(256)) * 2 + 1
    return F.conv(F.substring(digest, place, F.lit(2)), 16, 10).cast("int")


def _pick(letters, number):
    return F.substring(F.lit(letters), F.pmod(number, F.lit(len(letters))) + 1, F.lit(1))


def _by_class(text, digest, offset=0, letters="abcdefghijklmnopqrstuvwxyz"):
    """``text`` with every digit and letter replaced by one of its class and script."""

    def replaced(c, at):
        number = _number(digest, at + offset)
        return (
            F.when(c.rlike(r"\d"), _pick("0123456789", number))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick("абвгдежзиклмнопрстуфхцчшэюя", number))
            .when(c.rlike(r"\p{IsGreek}"), _pick("αβγδεζηθικλμνξοπρστυφχψω", number))
            .when(c.rlike(r"\p{L}"), _pick(letters, number))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), replaced), "")


def _luhn_sum(digits):
    """Luhn sum of a string of digits, its last digit counted once."""
    size = F.length(digits)

    def value(at):
        d = F.substring(digits, size - at, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(at % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(
        F.transform(F.sequence(F.lit(0), size - 1), value), F.lit(0), lambda a, b: a + b
    )


def _card(canonical, digest):
    """First digit and, for a number with a valid check digit, that property stay."""
    size = F.length(canonical)
    body = F.concat(
        F.substring(canonical, 1, 1), _by_class(F.substring(canonical, F.lit(2), size - 2), digest)
    )
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    free = _pick("0123456789", _number(digest, F.lit(200)))
    valid = F.pmod(_luhn_sum(canonical), F.lit(10)) == 0
    return F.concat(body, F.when(valid, check.cast("string")).otherwise(free))


def _name_word(script, digest, at, ending):
    parts = SYLLABLES[script].split()
    pieces = [
        F.element_at(
            F.array(*[F.lit(p) for p in parts]),
            F.pmod(_number(digest, at * 5 + k) , F.lit(len(parts))) + 1,
        )
        for k in range(3)
    ]
    return F.concat(*pieces, ending)


def _person(canonical, digest):
    """As many words as the name, in its script; the first one's ending tells the gender,
    and either may be drawn for a title that tells none."""
    name = F.substring(canonical, F.lit(3), F.length(canonical))
    gender = F.substring(canonical, 1, 1)
    female = (gender == "f") | ((gender == "n") & (_number(digest, F.lit(250)) % 2 == 1))

    def words(script):
        male_end, female_end = ENDINGS[script]
        ending = F.when(female, female_end).otherwise(male_end)

        def word(old, at):
            new = _name_word(script, digest, at, F.when(at == 0, ending).otherwise(F.lit("")))
            return F.when(old.rlike(r"^[ -]$"), old).otherwise(new)

        parts = F.split(F.regexp_replace(name, "([ -])", "\u0001$1\u0001"), "\u0001")
        return F.array_join(F.transform(parts, word), "")

    new = F.when(name.rlike(r"\p{IsCyrillic}"), words("cyrillic")).otherwise(words("latin"))
    return F.concat(F.substring(canonical, 1, 2), new)


def _more_syllables(digest, extra, cyrillic):
    def drawn(script):
        parts = F.array(*[F.lit(p) for p in SYLLABLES[script].split()])
        size = len(SYLLABLES[script].split())
        places = [F.pmod(_number(digest, F.lit(150 + k)), F.lit(size)) + 1 for k in range(extra)]
        return F.concat(F.lit(""), *[F.element_at(parts, place) for place in places])

    return F.when(cyrillic, drawn("cyrillic")).otherwise(drawn("latin"))


def _widened(kind, surrogate, digest, extra):
    """``surrogate`` with ``extra`` more syllables before a name, letters after the local
    part of an email, digits after a phone number; other kinds have a fixed form."""
    letters = _by_class(F.lit("a" * extra), digest, 150)
    local = F.substring_index(surrogate, "@", 1)
    more = _more_syllables(digest, extra, surrogate.rlike(r"\p{IsCyrillic}"))
    name = F.substring(surrogate, F.lit(3), F.length(surrogate))
    return (
        F.when(kind == "email", F.concat(local, letters, F.lit("@"), F.substring_index(surrogate, "@", -1)))
        .when(kind == "person", F.concat(F.substring(surrogate, 1, 2), more, name))
        .when(kind == "phone", F.concat(surrogate, _by_class(F.lit("0" * extra), digest, 150)))
        .otherwise(surrogate)
    )


def surrogate_of(kind, canonical, attempt, key):
    """Canonical form of the surrogate; same type, length and layout (a name or an
    address keeps its number of parts)."""
    digest = _digest(key, kind, canonical, attempt.cast("string"))
    local = F.substring_index(canonical, "@", 1)
    domain = F.substring_index(canonical, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    # A domain keeps its surrogate over all its addresses.
    host = _by_class(host, _digest(key, F.lit("domain"), domain))
    octets = [F.pmod(_number(digest, F.lit(k)), F.lit(254)) + 1 for k in range(4)]
    country = F.regexp_extract(canonical, r"^1|^[27]\d|^\d{2}", 0)
    return (
        F.when(kind == "email", F.concat(_by_class(local, digest), F.lit("@"), host, top))
        .when(kind == "ip", F.concat_ws(".", *[o.cast("string") for o in octets]))
        .when(kind.isin("token", "mac", "ipv6"), _by_class(canonical, digest, letters="abcdef"))
        .when(kind == "key", F.concat(F.substring(canonical, 1, 4), _by_class(F.expr("substring(canonical, 5)"), digest)))
        .when(kind == "card", _card(canonical, digest))
        .when(kind == "person", _person(canonical, digest))
        .when(
            kind == "iban",
            F.concat(F.substring(canonical, 1, 2), _by_class(F.expr("substring(canonical, 3)"), digest)),
        )
        .when(
            (kind == "phone") & (F.length(canonical) > 10),
            F.concat(
                country,
                _by_class(F.substring(canonical, F.length(country) + 1, F.length(canonical)), digest),
            ),
        )
        .otherwise(_by_class(canonical, digest))
    )


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) of distinct entities; no two entities of a kind share a
    surrogate, and none is a real entity. Entities whose draw collides, all but the first of
    equal draws, draw again; after ``WIDEN_AFTER`` rounds names, emails and phone numbers
    draw from ever longer surrogates, so that any number of them gets one. Kinds of a fixed
    form have 10 ** 9 surrogates or more; what they leave after ``MAX_ROUNDS`` rounds raises
    an error."""
    real = entities.select("kind", F.col("canonical").alias("surrogate")).hint("merge")
    left = entities.select("kind", "canonical")
    done = None
    for attempt in range(MAX_ROUNDS):
        draw = surrogate_of(F.col("kind"), F.col("canonical"), F.lit(attempt), key)
        if attempt >= WIDEN_AFTER:
            digest = _digest(key, F.col("kind"), F.col("canonical"), F.lit(f"wider {attempt}"))
            draw = _widened(F.col("kind"), draw, digest, attempt - WIDEN_AFTER + 1)
        drawn = written(spread(left, "canonical").withColumn("surrogate", draw), "pii-drawn")
        free = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.hint("merge"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
        won = written(won.select("kind", "canonical", "surrogate"), "pii-assigned")
        done = won if done is None else done.unionByName(won)
        left = written(
            drawn.join(won.hint("merge"), ["kind", "canonical"], "left_anti").select("kind", "canonical"),
            "pii-left",
        )
        if left.isEmpty():
            return done
    raise ValueError(f"entities of a fixed form without a free surrogate after {MAX_ROUNDS} draws")


def render(kind, mention, surrogate):
    """The surrogate in the layout and case of the mention."""
    shown = F.when(kind == "person", F.substring(surrogate, F.lit(3), F.length(surrogate)))
    title = F.regexp_extract(mention, rf"^(?:{_TITLES})\.? ", 0)
    upper = F.length(title) + 2
    all_upper = F.substring(mention, upper, F.lit(1)).rlike(r"\p{Lu}")
    name = F.when(all_upper, F.upper(shown)).otherwise(
        F.regexp_replace(F.initcap(F.regexp_replace(shown, "-", "- ")), "- ", "-")
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def filled(shape, new):
        """``shape`` with the letters and digits of ``new``, and those that are left over."""
        letters = F.regexp_replace(new, r"[^\p{L}\p{N}]", "")

        def fill(state, c):
            letter = F.substring(letters, state["used"] + 1, F.lit(1))
            letter = F.when(c.rlike(r"\p{Lu}"), F.upper(letter)).otherwise(letter)
            taken = c.rlike(r"[\p{L}\p{N}]")
            return F.struct(
                F.concat(state["out"], F.when(taken, letter).otherwise(c)).alias("out"),
                (state["used"] + F.when(taken, 1).otherwise(0)).alias("used"),
            )

        def whole(state):
            return F.concat(state["out"], F.substring(letters, state["used"] + 1, F.length(letters)))

        return F.aggregate(F.split(shape, ""), start, fill, whole)

    local, host = ([F.substring_index(x, "@", k) for x in (mention, surrogate)] for k in (1, -1))
    email = F.concat(filled(*local), F.lit("@"), filled(*host))
    return (
        F.when(kind == "person", F.concat(title, name))
        .when(kind == "ip", surrogate)
        .when((kind == "email") & F.contains(mention, F.lit("@")), email)
        .otherwise(filled(mention, surrogate))
    )


def _bare_names(shown):
    """Names of two words or more behind the titles in a map of mentions to what is shown,
    each with the name shown for it, in their case and in capitals; the longest first."""
    title = rf"^(?:{_TITLES})\.? "

    def bare(text):
        return F.regexp_replace(text, title, "")

    named = F.filter(F.map_entries(shown), lambda e: e["key"].rlike(title) & F.contains(bare(e["key"]), F.lit(" ")))
    plain = F.transform(
        named, lambda e: F.struct(bare(e["key"]).alias("name"), bare(e["value"]).alias("shown"))
    )
    capitals = F.transform(
        plain, lambda p: F.struct(F.upper(p["name"]).alias("name"), F.upper(p["shown"]).alias("shown"))
    )
    keyed_ = F.transform(
        F.array_union(plain, capitals), lambda p: F.struct((-F.length(p["name"])).alias("n"), p.alias("p"))
    )
    return F.transform(F.array_sort(keyed_), lambda k: k["p"])


def _without_names(part, names):
    """(text, n): a text with the bare names replaced, and how many were. Names hold letters,
    blanks and hyphens only, so they are patterns as they stand."""

    def step(state, p):
        pattern = F.concat(F.lit(r"(?<!\p{L}|\p{L}-)"), p["name"], F.lit(r"(?!\p{L}|-\p{L})"))
        return F.struct(
            F.regexp_replace(state["text"], pattern, p["shown"]).alias("text"),
            (state["n"] + F.regexp_count(state["text"], pattern)).alias("n"),
        )

    return F.aggregate(names, F.struct(part.alias("text"), F.lit(0).alias("n")), step)


def _woven(text, shown):
    """(text, n): a text with its mentions replaced by ``shown``, a map, and the names of its
    titled persons where they stand without title."""
    here = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))

    def of_names(names):
        between = F.transform(F.split(text, ANY, -1), lambda part: _without_names(part, names))
        return let(between, of_parts)

    def of_parts(parts):
        new = F.array_append(F.transform(here, lambda m: F.element_at(shown, m)), F.lit(""))
        woven = F.zip_with(parts, new, lambda a, b: F.concat(a["text"], b))
        bare = F.aggregate(parts, F.lit(0), lambda n, part: n + part["n"])
        return F.struct(F.array_join(woven, "").alias("text"), (F.size(here) + bare).cast("long").alias("n"))

    return let(_bare_names(shown), of_names)


def let(value, body):
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_entities(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, plus n_replaced (mentions).

    The same entity has the same surrogate all over the corpus, different entities have
    different ones, and the same key gives the same result again. A person is told by a
    title; the same name of two words or more is then replaced all over the document, with
    or without one. Null texts stay null,
    texts without entities stay as they are; repeated rows are all treated, extra columns
    pass through but for one named n_replaced; an empty table stays empty. An entity in
    very many documents is counted once before it meets them; a join spreads its
    documents over tasks. Texts without an entity are not moved, but for the few that a
    filter of fixed size takes for others.
    """
    with_key, keys = keyed(docs)
    found = written(
        with_key.select(*keys, F.explode(F.array_distinct(mentions_in(F.col("text")))).alias("mention")),
        "pii-mentions",
    )
    kinds = spread(found.select("mention").distinct(), "mention").withColumn("kind", kind_of(F.col("mention")))
    mentions = written(
        kinds.withColumn("canonical", canonical_of(F.col("kind"), F.col("mention"))), "pii-kinds"
    )
    entities = written(mentions.select("kind", "canonical").distinct(), "pii-entities")
    surrogates = assign_surrogates(entities, key)
    shown = render(F.col("kind"), F.col("mention"), F.col("surrogate"))
    replaced = written(
        spread(mentions.join(surrogates.hint("merge"), ["kind", "canonical"]), "mention").select(
            "mention", shown.alias("shown")
        ),
        "pii-replacements",
    )
    pair = F.struct("mention", "shown")
    mark, likely, woven = (fresh(with_key, c) for c in ("_shown", "_likely", "_woven"))
    # A set, as rows with the same id and text list the same mentions.
    per_text = found.join(replaced.hint("merge"), "mention").groupBy(*keys)
    per_text = written(
        per_text.agg(F.map_from_entries(F.collect_set(pair)).alias(mark)), "pii-texts"
    )
    holding = written(key_bitmaps(per_text.select(keys[0])), "pii-filter")
    split = with_likely(with_key, F.col(keys[0]), holding, likely)
    others = [c for c in docs.columns if c != "n_replaced"]
    apart = split.where(~F.col(likely)).select(*others, F.lit(0).cast("long").alias("n_replaced"))
    joined = split.where(likely).join(per_text.hint("merge"), keys, "left")
    changed = F.when(F.col(mark).isNotNull(), _woven(F.col("text"), F.col(mark)))
    joined = joined.withColumn(woven, changed)
    text = F.when(F.col(mark).isNull(), F.col("text")).otherwise(F.col(f"{woven}.text"))
    count = F.coalesce(F.col(f"{woven}.n"), F.lit(0).cast("long"))
    together = joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in others], count.alias("n_replaced")
    )
    return apart.unionByName(together)


def op1_pii_surrogates(spark, sf_dir):
    return replace_entities(read(spark, sf_dir, "documents").select("doc_id", "text"))
