"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Patterns find candidates; those of the four base kinds that pass their kind's check always stay. Five labelers vote on
each candidate for (1), against (-1) or not at all (0): its shape, a gazetteer, cues in the words before it, what touches
it, and a list of well-known placeholders. Expectation-maximisation on the counts of vote patterns estimates, for each
kind, how often personal and other spans get each vote. The posteriors of that mixture then train the final span
classifier, a naive Bayes model over the votes and over features that no labeler sees (length, digits, neighbouring
characters, word before). A candidate of another than the base kinds becomes a span if the classifier gives it
``THRESHOLD`` and more labelers vote for it than against it.

All steps are built-in functions, hash aggregates and equi-joins. A vote pattern has 3 ** 5 values at most, so the EM of a
kind is one expression over a bounded array; the classifier has a bounded number of features of each kind.

Defined cases: a null text counts as empty; an empty text has no spans; equal texts have equal spans and count once in the
estimates; null and repeated ids come back as often as they came in; an empty table gives an empty result; other columns of
the input are not read. Patterns take time linear in a text: their repetitions are possessive or bounded, and begin
where a run begins; each starts with the character that it needs, which passes over all other places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.storage import materialize

ROUNDS = 12  # of EM
THRESHOLD = 0.8
STRENGTH, SHARE = 8.0, 0.1  # a labeler's first guess weighs as much as so many spans, and so great a part of all
FIRST_GUESS = {1: 0.5, 0: 0.35, -1: 0.15}  # votes on personal spans; on others with the sign turned
BEFORE = 32  # characters before a candidate that cues are searched in
WORD_BUCKETS = 64

# Gazetteers, cues (lower case) and placeholders.
GIVEN_NAMES = "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Susan Thomas Sarah Karen Nancy Daniel Anna Peter Paul Laura Maria Jose Carlos Juan Luis Carmen Pedro Sofia Hans Klaus Ursula Jürgen Wolfgang Helga Pierre Jean Marie Michel Claire Nicolas François Julie Antonio Ana Miguel Lucia".split()
NOT_NAMES = "The This That These Those United New North South East West Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Public License General Version Creative Commons Apache Software University Street Avenue".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Señor Señora Monsieur Madame".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Ct Square Way Terrace".split()
TOP_DOMAINS = "com org net edu gov mil info biz io co de fr es it nl eu uk us ca au ch at be pl br mx ar jp cn in ru se no dk fi pt ie".split()
CUES = {
    "email": "mail contact write reach address courriel correo",
    "ip": "ip host server address client from login peer",
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta",
    "phone": "phone tel call fax mobile cell whatsapp telefon téléphone teléfono",
    "local_phone": "phone tel call fax mobile cell whatsapp telefon téléphone teléfono",
    "national_id": "ssn social security tax identification passport",
    "iban": "iban account bank konto compte cuenta",
    "person": "name dear signed sincerely contact patient customer employee called",
    "street": "address live lives resides located ship deliver home",
}
COUNTER_CUES = "order invoice isbn issn version serial ticket build revision figure table chapter section part sku item model"
PLACEHOLDERS = ("123-45-6789", "000-00-0000", "078-05-1120", "555-123-4567", "123-456-7890", "John Doe", "Jane Doe", "123 Main Street", "123 Main St")
_ANY = "|".join

_LOCAL = "A-Za-z0-9._%+-"
_OWN = r"(?<![\p{L}\p{N}].)"  # behind its first character: a word began there
_END = r"(?![\p{L}\p{N}])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers; null unless it has 12 to 19."""
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, value(i)).otherwise(twice(value(i))))
    return F.when(F.length(digits).between(12, 19), total % 10 == 0)


def mod_97(account: Column) -> Column:
    """Whether an account number (letters and digits) has the remainder 1 of its standard."""
    turned = F.concat(F.substring(account, 5, F.lit(40)), F.left(account, F.lit(4)))
    step = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.try_cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """``check`` drops matches; ``shape`` and ``known`` are the votes of two labelers on a match. A text without ``needs`` has none."""

    name: str
    pattern: str
    check: Callable[[Column], Column]
    shape: Callable[[Column], Column]
    known: Callable[[Column], Column]
    base: bool = False
    needs: str = ""


def _vote(good: Column, bad: Column | None = None) -> Column:
    v = F.when(good, 1)
    return (v.when(bad, -1).otherwise(0) if bad is not None else v.otherwise(-1)).cast("tinyint")


def _yes(m: Column) -> Column:
    return F.lit(True)


_OCTET = r"0*+(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])?(?=\.|\z)"
KINDS = (
    Kind(
        # a run of local characters is tried once: where it begins, or where the match before it ended
        "email", rf"[{_LOCAL}](?:(?<![{_LOCAL}]{{2}})|(?<=\G.))[{_LOCAL}]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _yes,
        lambda m: _vote(m.rlike(r"\.[A-Za-z]{2,24}\z")), lambda m: _vote(F.lower(F.regexp_extract(m, r"\.([A-Za-z0-9-]+)\z", 1)).isin(*TOP_DOMAINS)), True, "@",
    ),
    Kind(
        "ip", r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}", lambda m: m.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"),
        lambda m: _vote(~m.rlike(r"(?:\A|\.)0[0-9]")), lambda m: _vote(m.rlike(r"\A(?:[1-9]|1[0-9]|2[0-2])[0-9]{0,2}\."), m.rlike(r"\A(?:0|127|2[3-5][0-9])\.")), True,
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++", lambda m: luhn(_digits(m)),
        lambda m: _vote(m.rlike(r"\A(?:[0-9]{12,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})\z")), lambda m: _vote(_digits(m).rlike(r"\A(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))")), True,
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15),
        lambda m: _vote(F.length(_digits(m)).between(10, 13), F.length(_digits(m)) == 15), lambda m: _vote(m.rlike(r"\A\+(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), m.rlike(r"\A\+0")), True, "+",
    ),
    Kind(
        "local_phone", r"[0-9(](?<![0-9.+()-].)(?<!\+[0-9]{1,3}[ .-]{0,1}.)(?:(?<=\()[0-9]{3}\)[ .-]?|(?<=[0-9])[0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])", _yes,
        lambda m: _vote(_digits(m).rlike(r"\A[2-9][0-9]{2}[2-9]")), lambda m: _vote(m.rlike(r"\A\("), m.rlike("[.]")),
    ),
    Kind(
        "national_id", r"[0-9](?<![0-9-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])", _yes,
        lambda m: _vote(m.rlike(r"\A(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")), lambda m: F.lit(0).cast("tinyint"),
    ),
    Kind(
        "iban", rf"[A-Z]{_OWN}[A-Z][0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}", lambda m: m.rlike("[0-9]{4}"),
        lambda m: _vote(mod_97(F.replace(m, F.lit(" "), F.lit("")))), lambda m: _vote(m.rlike(r"\A(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"), F.lit(False)),
    ),
    Kind(
        "person", rf"\p{{Lu}}{_OWN}\p{{Ll}}{{1,20}}(?:(?<={_ANY(TITLES)})\.)? \p{{Lu}}\p{{Ll}}{{1,20}}(?: \p{{Lu}}\p{{Ll}}{{1,20}})?{_END}", _yes,
        lambda m: _vote(m.rlike(rf"\A(?:{_ANY(TITLES)})\.? "), F.lit(False)), lambda m: _vote(m.rlike(rf"\b(?:{_ANY(GIVEN_NAMES)}) "), m.rlike(rf"\b(?:{_ANY(NOT_NAMES)})\b")),
    ),
    Kind(
        "street", rf"[0-9\p{{Lu}}]{_OWN}(?:(?<=[0-9])[0-9]{{0,4}} \p{{Lu}}\p{{Ll}}{{1,20}}(?: \p{{Lu}}\p{{Ll}}{{1,20}}){{0,2}} (?:{_ANY(STREETS)})|(?<=\p{{Lu}})\p{{Ll}}{{1,20}}(?:straße|strasse|gasse|platz) [0-9]{{1,4}}){_END}", _yes,
        lambda m: _vote(m.rlike("(?:Street|Avenue|Road|Lane|Drive|Boulevard|Square|straße|strasse)"), F.lit(False)), lambda m: F.lit(0).cast("tinyint"),
    ),
)
BASE_KINDS = tuple(k.name for k in KINDS if k.base)
LABELERS = ("shape", "gazetteer", "cue", "touch", "placeholder")


def _character(c: Column) -> Column:
    """Class of a neighbouring character."""
    return F.when(c == "", "edge").when(c.rlike(r"\s"), "space").when(c.rlike(r"\p{L}"), "letter").when(c.rlike("[0-9]"), "digit").otherwise("mark")


def _candidate(kind: Kind, match: Column, before: Column, after: Column) -> tuple[Column, Column]:
    """Votes and features of a match with the characters around it."""
    near = F.lower(before)
    # of cues for and against the nearer one counts: it ends the text before with fewer words behind it
    says = lambda words: near.rlike(rf"(?:{_ANY(words.split())})[\p{{L}}]*(?:[^\p{{L}}]+\p{{L}}{{1,4}}){{0,1}}[^\p{{L}}]*\z")
    cue = _vote(says(CUES[kind.name]), says(COUNTER_CUES))
    touched = F.when(after.rlike(r"[\p{L}\p{N}_/@]") | before.rlike(r"[\p{L}\p{N}_/@]\z"), -1).otherwise(0).cast("tinyint")
    placeholder = F.when(match.isin(*PLACEHOLDERS) | _digits(match).rlike(r"\A([0-9])\1{6,}\z"), -1).otherwise(0).cast("tinyint")
    votes = F.array(kind.shape(match), kind.known(match), cue, touched, placeholder)
    word = F.regexp_extract(near, r"([\p{L}]{1,20})[^\p{L}]*\z", 1)
    size = F.least(F.lit(7), F.floor(F.log2(F.length(match).cast("double"))).cast("int"))
    features = F.array(
        F.concat(F.lit("size="), size), F.concat(F.lit("digits="), F.least(F.lit(20), F.length(_digits(match)))), F.concat(F.lit("left="), _character(F.right(before, F.lit(1)))),
        F.concat(F.lit("right="), _character(after)), F.concat(F.lit("word="), F.pmod(F.xxhash64(word), F.lit(WORD_BUCKETS))),
    )
    return votes, features


_HITS = "array<struct<kind:string,gap:int,size:int,ok:boolean,votes:array<tinyint>,features:array<string>>>"


def _hits(text: Column, kind: Kind) -> Column:
    """Matches of a kind with the characters before them since the last match, whether they pass, votes and features."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)  # one more than matches
    n = F.size(found)
    around = F.zip_with(
        F.transform(F.slice(gaps, F.lit(1), n), lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(BEFORE)).alias("before"))),
        F.transform(F.slice(gaps, F.lit(2), n), lambda g: F.left(g, F.lit(1))),
        lambda b, a: F.struct(b["gap"].alias("gap"), b["before"].alias("before"), a.alias("after")),
    )

    def told(m, x):
        votes, features = _candidate(kind, m, x["before"], x["after"])
        return F.struct(F.lit(kind.name).alias("kind"), x["gap"].alias("gap"), F.length(m).alias("size"), F.coalesce(kind.check(m), F.lit(False)).alias("ok"), votes.alias("votes"), features.alias("features"))

    return F.when(text.contains(kind.needs) & text.rlike(kind.pattern), F.zip_with(found, around, told).cast(_HITS)).otherwise(F.array().cast(_HITS))


def candidates(docs: DataFrame, *, path: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """``(paths, found)``: every row's ``path, blob_id`` and each text's candidates ``blob_id, kind, start, end, votes, features``.

    Places are running sums over one text's matches of one kind. Both are written in the shared folder.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    paths = materialize(docs.select(F.col(path).alias("path"), F.sha2(whole, 256).alias("blob_id")), "paths")
    rows = docs.select(F.sha2(whole, 256).alias("blob_id"), whole.alias("t"))
    for i, k in enumerate(kinds):
        rows = rows.withColumn(f"hit{i}", _hits(F.col("t"), k))
    lists = F.filter(F.array(*[f"hit{i}" for i in range(len(kinds))]), lambda x: F.size(x) > 0)
    each = rows.select("blob_id", F.explode(lists).alias("hits")).dropDuplicates(["blob_id", "hits"])
    upto = Window.partitionBy("blob_id", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    match = each.select("blob_id", F.posexplode("hits").alias("nth", "h")).select("blob_id", "nth", "h.*")
    end = F.sum((F.col("gap") + F.col("size")).cast("long")).over(upto)
    found = match.withColumn("end", end).where("ok").select("blob_id", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "votes", "features")
    return paths, materialize(found, "candidates")


# --- how reliable labelers are ------------------------------------------------------------------------


def _guess(sign: int) -> list[float]:
    return [FIRST_GUESS[v * sign] for _ in LABELERS for v in (-1, 0, 1)]


def _log_odds(votes: Column, state: Column) -> Column:
    """Of a vote pattern under ``state``: the class's share and the chance of each labeler's votes in both classes."""
    part = lambda v, j: F.log(F.get(state["yes"], 3 * j + v + 1)) - F.log(F.get(state["no"], 3 * j + v + 1))
    return F.aggregate(F.transform(votes, part), F.log(state["share"]) - F.log(1 - state["share"]), lambda s, x: s + x)


def _chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), log_odds))))


def reliabilities(found: DataFrame) -> DataFrame:
    """``kind, state`` by expectation-maximisation over the counts of vote patterns (243 of a kind at most)."""
    array = lambda values: F.array(*[F.lit(float(v)) for v in values])
    counted = found.groupBy("kind", "votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    patterns = counted.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    first = {1: array(_guess(1)), -1: array(_guess(-1))}

    def maximise(weighed: Column) -> Column:
        n = F.aggregate(weighed, F.lit(0.0), lambda s, w: s + w["n"])

        def chances(sign: int) -> Column:
            share = lambda w: w["n"] * (w["p"] if sign == 1 else 1 - w["p"])
            guess = F.lit(STRENGTH) + SHARE * n
            total = F.aggregate(weighed, guess, lambda s, w: s + share(w))
            hit = lambda w, k: F.get(w["votes"], F.floor(k / 3).cast("int")).cast("int") == k % 3 - 1
            each = lambda g, k: F.aggregate(weighed, g * guess, lambda s, w: s + F.when(hit(w, k), share(w)).otherwise(0.0)) / total
            return F.transform(first[sign], each)

        share = F.aggregate(weighed, F.lit(STRENGTH), lambda s, w: s + w["n"] * w["p"]) / (n + 2 * STRENGTH)
        return F.struct(share.alias("share"), chances(1).alias("yes"), chances(-1).alias("no"))

    def one_round(state: Column, _: Column) -> Column:
        weighed = F.transform("patterns", lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), _chance(_log_odds(x["votes"], state)).alias("p")))
        return F.get(F.transform(F.array(weighed), maximise), F.lit(0))  # posteriors are computed once a round

    start = F.struct(F.lit(0.5).alias("share"), first[1].alias("yes"), first[-1].alias("no"))
    return patterns.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round).alias("state"))


def classifier(found: DataFrame, states: DataFrame) -> DataFrame:
    """One row with a map: the log odds of each kind's features, and of the kind itself (``kind:``), from the posteriors."""
    seen = found.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).cast("double").alias("n"))
    judged = seen.join(F.broadcast(states), "kind")  # one row for each kind
    judged = judged.withColumn("p", _chance(_log_odds(F.col("votes"), F.col("state"))))
    each = judged.select("kind", F.explode(F.concat(_named_votes(), "features", F.array(F.lit("")))).alias("feature"), (F.col("n") * F.col("p")).alias("yes"), (F.col("n") * (1 - F.col("p"))).alias("no"))
    sums = each.groupBy("kind", "feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))  # bounded by kinds and features
    totals = sums.where("feature = ''").select("kind", F.col("yes").alias("all_yes"), F.col("no").alias("all_no"))
    smooth = lambda a, b: F.log(F.col(a) + 1) - F.log(F.col(b) + 10)
    weight = F.when(F.col("feature") == "", F.log(F.col("yes") + 1) - F.log(F.col("no") + 1)).otherwise(smooth("yes", "all_yes") - smooth("no", "all_no"))
    entry = F.struct(F.concat_ws(":", "kind", "feature"), F.round(weight, 9))
    return sums.join(totals, "kind").agg(F.map_from_entries(F.collect_list(entry)).alias("weights"))


def _named_votes() -> Column:
    return F.array(*[F.concat(F.lit(f"{name}="), F.get("votes", F.lit(j))) for j, name in enumerate(LABELERS)])


def judged(found: DataFrame) -> DataFrame:
    """Candidates with ``chance``, the classifier's, and ``kept``."""
    weights = classifier(found, materialize(reliabilities(found), "reliabilities"))
    rows = found.crossJoin(F.broadcast(materialize(weights, "weights")))  # one row
    parts = F.transform(F.concat(_named_votes(), "features", F.array(F.lit(""))), lambda f: F.coalesce(F.element_at("weights", F.concat_ws(":", "kind", f)), F.lit(0.0)))
    rows = rows.withColumn("chance", _chance(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))).drop("weights")
    net = F.aggregate("votes", F.lit(0), lambda s, v: s + v)
    kept = F.col("kind").isin(*BASE_KINDS) | ((F.col("chance") >= THRESHOLD) & (net > 0))
    return rows.withColumn("kept", kept)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, *, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's ``path, spans array<struct<start, rank, end, kind>>``, sorted by start, then by the kinds' listed order."""
    paths, found = candidates(docs, path=path, text=text)
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k.name), F.lit(i))])
    span = F.struct("start", order[F.col("kind")].alias("rank"), "end", "kind")
    spans = judged(found).where("kept").groupBy("blob_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))  # bounded by a text
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return paths.join(spans, "blob_id", "left").select("path", F.coalesce("spans", none).alias("spans"))


def op12_personal_data(spark, sf_dir: str) -> DataFrame:
    """Every document's spans of personal data, with counts and a digest of the base kinds."""
    rows = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(F.col("path").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
