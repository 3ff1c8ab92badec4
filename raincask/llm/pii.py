"""Personal data by weak supervision; DataFrame functions only.

Candidates are the base spans of four kinds, looser ones that a base pattern misses or drops, and secrets:
long runs of letters and digits such as keys and tokens. Labelers of three sorts vote on each candidate for, against, or not at all: patterns (checksum, octets, digits),
gazetteers (domain endings, dialling codes, card issuers) and context words. Votes are counted by
pattern of votes; there are few patterns, however many spans. Expectation-maximisation on that table
estimates how often each labeler is right, and the posteriors train the final span classifier, a
logistic model over votes and shape. It decides on the loose candidates; base spans always stay.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
SECRET_KIND = len(BASE_KINDS)
#: Kinds whose shape labeler tests a number.
NUMBERS = (1, 2, 3)
SPANS = "array<struct<kind: int, start: long, stop: long, base: boolean, v1: int, v2: int, v3: int, v4: int>>"

# Patterns that give the leftmost matches without overlap, each begun where no earlier one could begin.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser forms: an address spelt out; a number with an area code but no plus; grouped in other ways.
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+[\x20]?(?:\(at\)|\[at\]|\{at\})[\x20]?[A-Za-z0-9-]{1,64}(?:[\x20]?(?:\.|\(dot\)|\[dot\]|\{dot\})[\x20]?[A-Za-z0-9-]{1,64}){1,5}"
LOOSE_PHONE = r"(?<![0-9+(.-])(?<![0-9+][\x20(])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])"
LOOSE_CARD = r"(?<![0-9.])[0-9]{4}[.][0-9]{4}[.][0-9]{4}[.][0-9]{4}(?![0-9]|[.][0-9])"
SECRET = r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/=-])"
#: Code points of text before a span that its labelers see.
BEFORE = 64
# Gazetteers (fixed values): endings of domains, first digits of card issuers, beginnings and lengths of keys, words near each kind.
ENDINGS = "com org net edu gov mil int info biz io ai dev app me co us uk de fr es it nl be ch at ie pt pl se no dk fi cz gr hu ro ru jp cn in kr br mx ar ca au nz za".split()
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38)"
KEYS = "^(?:sk-|pk_|rk_|gh[pousr]_|AKIA|ASIA|AIza|xox[abpr]-|eyJ|glpat-)"
CONTEXT = {
    0: "mail|e-mail|email|contact|write|reach|correo|courriel|address",
    1: "ip|host|server|address|login|connect|ping|client|adresse|direcci",
    2: "card|visa|mastercard|amex|credit|debit|payment|karte|tarjeta|carte",
    3: "phone|tel|call|mobile|cell|fax|whatsapp|sms|telefon|llame|appel|contact",
    4: "token|key|secret|passw|auth|bearer|credential|clave|schl.ssel",
}


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.split(F.reverse(number), "")
    each = F.transform(F.filter(backwards, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def octets(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: p.rlike("^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


#: Elements in a run of `scan`: its cost grows with the product of this and their number.
SCAN = 128


def scan(a: Column, step, zero: Column) -> Column:
    """Running values step(... step(step(zero, a[0]), a[1]) ...), one for each element; step has to be associative.

    A fold that appends copies what it has, so runs of SCAN elements are folded by themselves, then the
    totals of the runs, and the runs are shifted by the total before them.
    """
    def fold(x: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<long>").alias("out"))

        def one(acc: Column, v: Column) -> Column:
            at = step(acc["at"], v)
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(x, start, one, lambda acc: acc["out"])

    def joined(runs: Column) -> Column:
        totals = fold(F.transform(runs, lambda r: F.element_at(r, -1)))
        before = F.slice(F.concat(F.array(zero), totals), F.lit(1), F.size(runs))
        return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), before.alias("base")), lambda z: F.transform(z["run"], lambda v: step(z["base"], v))))

    def cut(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / SCAN).cast("int"))
        return F.transform(at, lambda k: fold(F.slice(x, k * SCAN + 1, F.lit(SCAN))))

    # A lambda's argument is evaluated once; a column used twice would be made twice.
    def bound(x: Column, make) -> Column:
        return F.element_at(F.transform(F.array(x), make), 1)

    return bound(a, lambda x: F.when(F.size(x) > SCAN, bound(cut(x), joined)).otherwise(fold(x)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, value, before>>: code points of the successive matches, and the text before each, BEFORE at most."""
    def placed(parts: Column) -> Column:
        pairs = F.arrays_zip(F.slice(parts["gaps"], 1, F.size(parts["values"])).alias("gap"), parts["values"].alias("value"))
        stops = scan(F.transform(pairs, lambda x: (F.length(x["gap"]) + F.length(x["value"])).cast("long")), lambda total, n: total + n, F.lit(0).cast("long"))
        each = F.arrays_zip(pairs.alias("pair"), stops.alias("stop"))
        return F.transform(each, lambda z: F.struct((z["stop"] - F.length(z["pair"]["value"])).alias("start"), z["stop"].alias("stop"), z["pair"]["value"].alias("value"), F.right(z["pair"]["gap"], F.lit(BEFORE)).alias("before")))

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), F.element_at(F.transform(F.array(parts), placed), 1))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _candidates(found: Column, kind: int, base) -> Column:
    """Candidates of one kind with the votes of its four labelers: shape, gazetteer, context, surroundings; `base` tells which are base spans."""
    def candidate(m: Column) -> Column:
        value, number = m["value"], digits(m["value"])
        if kind == 0:
            end = F.lower(F.regexp_extract(value, "(?<![A-Za-z0-9-])([A-Za-z0-9-]++)$", 1))
            shape = _vote(value.rlike(r"^[A-Za-z0-9][^@]*[A-Za-z0-9]?[\x20]?[@(\[{]"), value.rlike(r"^[._%+-]|\.\.|-$"))
            gazetteer = _vote(end.isin(ENDINGS), F.length(end) < 2)
        elif kind == 1:
            shape = _vote(octets(value) & ~value.rlike(r"(?:^|\.)0[0-9]"), ~octets(value))
            gazetteer = _vote(value.rlike(r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|[1-9][0-9]{1,2}\.)"), value.rlike(r"^0"))
        elif kind == 2:
            shape = _vote(luhn(number), ~luhn(number))
            gazetteer = _vote(number.rlike(ISSUERS), number.rlike("^0"))
        elif kind == 3:
            shape = _vote(F.length(number).between(9, 15), ~F.length(number).between(9, 15))
            gazetteer = _vote(number.rlike("^(?:1?[2-9][0-9]{2}[2-9]|[2-9][0-9]{8,14}$)"), number.rlike("^0{3}|^1?[01]"))
        else:
            mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9].*[0-9]")
            shape = _vote(value.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | mixed, value.rlike("^[0-9_+/=-]+$|^[A-Za-z]++(?:[-_/+][A-Za-z0-9]{1,12}+){2,}+$"))
            gazetteer = _vote(value.rlike(KEYS) | F.length(value).isin(32, 40, 64), value.rlike("/.*/"))
        against = r"(?:commit|sha[0-9]*|md5|checksum|digest|revision)[\x20:#=\x22']*$" if kind == SECRET_KIND else r"(?:version|v\.|section|isbn|issn|order|invoice|id|no\.?|figure|table|page)[\x20:#]*$"
        context = _vote(F.lower(m["before"]).rlike(rf"(?:{CONTEXT[kind]})[^\n]{{0,40}}$"), F.lower(m["before"]).rlike(against))
        around = _vote(m["before"].rlike(r"[=:]\s*[\x22']?$|[\x22'`]$" if kind == SECRET_KIND else r"(?:^|[\s(,;:<])$"), m["before"].rlike(r"[A-Za-z0-9_/\\=-]$"))
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), base(m).alias("base"), shape.alias("v1"), gazetteer.alias("v2"), context.alias("v3"), around.alias("v4"))

    return F.coalesce(F.transform(found, candidate), F.expr(f"cast(array() as {SPANS})"))


def candidates(text: Column) -> Column:
    """All candidate spans of a text. What a base pattern finds and its rule drops is a loose candidate."""
    only, yes, no = F.when, lambda m: F.lit(True), lambda m: F.lit(False)
    parts = [
        _candidates(only(text.contains("@"), matches(text, EMAIL)), 0, yes),
        _candidates(only(text.rlike(r"[0-9]\.[0-9]"), matches(text, IP)), 1, lambda m: octets(m["value"])),
        _candidates(only(text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), matches(text, CARD)), 2, lambda m: luhn(digits(m["value"]))),
        _candidates(only(text.contains("+"), matches(text, PHONE)), 3, lambda m: F.length(digits(m["value"])).between(9, 15)),
        _candidates(only(text.rlike(r"[\(\[\{]at[\)\]\}]"), matches(text, LOOSE_EMAIL)), 0, no),
        _candidates(only(text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), matches(text, LOOSE_PHONE)), 3, no),
        _candidates(only(text.rlike(r"[0-9]{4}\.[0-9]{4}\."), matches(text, LOOSE_CARD)), 2, no),
        _candidates(only(text.rlike(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/-]{20}"), matches(text, SECRET)), SECRET_KIND, no),
    ]
    return F.concat(*parts)


def apart(spans: Column) -> Column:
    """The spans that are not base ones and overlap none of those; two scans over all spans in order of their starts."""
    none, far = F.lit(-1).cast("long"), F.lit((1 << 62)).cast("long")

    def kept(sorted_spans: Column) -> Column:
        stops = scan(F.transform(sorted_spans, lambda s: F.when(s["base"], s["stop"]).otherwise(none)), lambda x, y: F.greatest(x, y), none)
        starts = F.reverse(scan(F.reverse(F.transform(sorted_spans, lambda s: F.when(s["base"], s["start"]).otherwise(far))), lambda x, y: F.least(x, y), far))
        each = F.arrays_zip(sorted_spans.alias("span"), stops.alias("before"), starts.alias("after"))
        clear = F.filter(each, lambda z: ~z["span"]["base"] & (z["before"] <= z["span"]["start"]) & (z["after"] >= z["span"]["stop"]))
        return F.transform(clear, lambda z: z["span"])

    by_start = F.array_sort(spans, lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0))
    return F.element_at(F.transform(F.array(by_start), kept), 1)


VOTES = ("v1", "v2", "v3", "v4")


def expectation_maximisation(table: list[tuple[tuple[int, ...], float]], rounds: int = 50, prior: float = 0.5) -> tuple[list[float], list[dict[int, list[float]]], float]:
    """Posteriors of each pattern of votes, each labeler's P(vote | class), and the share of true spans.

    Labelers are independent given the class; counts start from labelers that are right more often than
    not, and keep one count of that belief, so that a labeler nobody hears has no effect.
    """
    total = sum(n for _, n in table)
    belief = {1: (0.1, 0.6), 0: (0.3, 0.3), -1: (0.6, 0.1)}
    rate = [{v: list(belief[v]) for v in (-1, 0, 1)} for _ in VOTES]
    share, posterior = prior, []
    for _ in range(rounds):
        posterior = []
        for votes, _ in table:
            odds = math.log(share / (1 - share)) + sum(math.log(rate[k][v][1] / rate[k][v][0]) for k, v in enumerate(votes))
            posterior.append(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
        weight = sum(p * n for p, (_, n) in zip(posterior, table))
        share = (weight + 1) / (total + 2)
        for k in range(len(VOTES)):
            for v in (-1, 0, 1):
                yes = sum(p * n for p, (votes, n) in zip(posterior, table) if votes[k] == v)
                no = sum((1 - p) * n for p, (votes, n) in zip(posterior, table) if votes[k] == v)
                rate[k][v] = [(no + belief[v][0]) / (total - weight + 1), (yes + belief[v][1]) / (weight + 1)]
    return posterior, rate, share


def features(votes: tuple[int, ...], kind: int) -> list[float]:
    return [1.0, *(float(v > 0) for v in votes), *(float(v < 0) for v in votes), *(float(kind == k) for k in range(1, len(KINDS)))]


def train_logistic(rows: list[tuple[list[float], float, float]], rounds: int = 300, decay: float = 1.0) -> list[float]:
    """Weights fit to (features, soft label, count) by damped gradient steps with per-weight scaling."""
    width = len(rows[0][0])
    weight, scale = [0.0] * width, [1e-9] * width
    total = sum(n for _, _, n in rows)
    for _ in range(rounds):
        slope = [decay * w / total for w in weight]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, sum(a * b for a, b in zip(weight, x))))))
            for i, a in enumerate(x):
                slope[i] += n / total * (p - y) * a
        for i, g in enumerate(slope):
            scale[i] += g * g
            weight[i] -= 0.5 * g / math.sqrt(scale[i])
    return weight


def accepted(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = 50) -> list[tuple[int, tuple[int, ...]]]:
    """(kind, votes) of the patterns that the span classifier takes; EM runs for each kind by itself.

    Of numbers, whose shape is a checksum, a range or a count of digits, none is taken whose shape is against it.
    """
    rows = []
    for kind in range(len(KINDS)):
        table = [(v, n) for k, v, n in patterns if k == kind]
        if table:
            posterior, _, _ = expectation_maximisation(table, rounds)
            rows += [(features(v, kind), p, n) for p, (v, n) in zip(posterior, table)]
    if not rows:
        return []
    weight = train_logistic(rows)
    return [(k, v) for k in range(len(KINDS)) for v in itertools.product((-1, 0, 1), repeat=len(VOTES)) if (v[0] >= 0 or k not in NUMBERS) and sum(a * b for a, b in zip(weight, features(v, k))) > 0]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base and spans, both arrays of (kind, start, stop) by start and kind.

    Kinds are 0 email, 1 ip, 2 card, 3 phone, 4 secret; positions are code points, the stop is exclusive.
    `base` has all base spans, none of them a secret; `spans` also has the loose candidates that the
    classifier takes: secrets, and others that overlap no base span. A null text counts as empty; ids may be null or repeat; an empty table
    gives no rows. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
    spans = materialise(base.select("doc_id", candidates(F.col("t")).alias("c")), "candidates")
    counts = spans.select(F.explode("c").alias("s")).groupBy("s.kind", *(f"s.{v}" for v in VOTES)).agg(F.count("*").alias("n")).collect()
    taken = accepted([(r.kind, tuple(r[v] for v in VOTES), float(r.n)) for r in counts])
    codes = [kind * 81 + sum((v + 1) * 3**i for i, v in enumerate(votes)) for kind, votes in taken]

    def take(s: Column) -> Column:
        code = s["kind"] * 81 + sum(((s[v] + 1) * 3**i for i, v in enumerate(VOTES)), F.lit(0))
        return code.isin(codes) if codes else F.lit(False)

    def plain(a: Column) -> Column:
        return F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))

    own = F.filter("c", lambda s: s["base"])
    secrets = F.filter("c", lambda s: ~s["base"] & take(s) & (s["kind"] == SECRET_KIND))
    others = F.filter("c", lambda s: s["base"] | (take(s) & (s["kind"] != SECRET_KIND)))
    loose = F.when(F.exists("c", lambda s: ~s["base"] & (s["kind"] != SECRET_KIND)), F.concat(secrets, apart(others))).otherwise(secrets)
    return spans.select("doc_id", plain(own).alias("base"), plain(F.when(F.exists("c", lambda s: ~s["base"]), F.concat(own, loose)).otherwise(own)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")
