"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs them, a classifier decides.

DataFrame functions only. The model is fitted to counts of vote patterns, which are a fixed number however large the corpus is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

KINDS = ("email", "ip", "card", "phone")
# The contract's expressions, written so that the matcher neither recurses nor goes back: possessive where nothing after a
# repetition could match what it has taken, and no second start within a run that has failed already.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[0-9]|[\x20-][0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
# Candidates beyond the base spans: what the base expressions miss or drop.
WIDE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\.)\s?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,4}(?![0-9])",
    "phone": r"(?<![0-9.(-])(?:00[1-9][0-9\x20-]{7,14}[0-9]|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9])",
}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mails?|mail|contact|correo|courriel)\W{0,4}(?:\w+\W{1,3}){0,2}$",
    "ip": r"(?i)\b(?:ips?|ipv[46]|host|server|address|addr)\W{0,4}(?:\w+\W{1,3}){0,2}$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte)\W{0,4}(?:\w+\W{1,3}){0,2}$",
    "phone": r"(?i)\b(?:tel|phone|mobile|cell|call|fax|telefon|t[eé]l[eé]phone|tel[eé]fono)\W{0,4}(?:\w+\W{1,3}){0,2}$",
}
AGAINST = r"(?i)\b(?:version|v|release|order|isbn|issn|invoice|sku|id|hash|token|serial|build|section|chapter)\W{0,4}$"
# Gazetteers: top-level domains, networks that belong to no one, card issuers with their lengths, country calling codes.
TLDS = (
    "com org net edu gov mil int arpa info biz name pro aero coop museum mobi jobs travel tel cat asia post xxx app dev page cloud online site shop store blog tech club xyz top live email news agency "
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu "
    "fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly "
    "ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn "
    "so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
).split()
NO_ONES = r"^(0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])[.]|^169[.]254[.]|^192[.]0[.](0|2)[.]|^198[.](18|19|51[.]100)[.]|^203[.]0[.]113[.]|^(0{1,4}:)+|^ff|^2001:0?db8:"
ISSUERS = (
    r"^4([0-9]{12}|[0-9]{15}|[0-9]{18})$|^(5[1-5]|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]*$|^3[47][0-9]{13}$|^3(0[0-59]|[689])[0-9]{11,16}$|^(6011|64[4-9]|65)[0-9]{12,15}$"
    r"|^35(2[89]|[3-8][0-9])[0-9]{12,15}$|^62[0-9]{14,17}$|^(50|5[6-9]|6[0-9])[0-9]{10,17}$|^220[0-4][0-9]{12,15}$|^9792[0-9]{12}$"
)
CALLING = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 22[0-9] 23[0-9] 24[0-9] 25[0-8] 26[0-9] "
    "290 291 297 298 299 35[0-9] 37[0-8] 380 381 382 383 385 386 387 389 420 421 423 50[0-9] 59[0-9] 67[0-9] 68[0-9] 69[0-2] 800 808 850 852 853 855 856 870 878 880 881 882 883 886 888 96[0-8] 97[0-79] 99[2-68]"
).split()
LABELERS = 5
FEATURES = (6, 4, 4, 4, 3, 4)  # values of each span feature: length, separators, sign before, sign after, distinct digits, words before
MATCH = "struct<s:bigint,e:bigint,m:string,b:string,a:string>"
SPAN = "array<struct<k:int,s:bigint,e:bigint,base:boolean,v:array<int>,f:array<int>>>"


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with name standing for value, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, start: str, step: Callable[[str, str], str]) -> str:
    """SQL of what a fold over an array of longs holds before each of its elements: start, then step(held, element).
    Blocks of about the square root of the array are folded apart, so that no growing array is copied once an element."""

    def fold(over: str, first: str) -> str:
        held = f"named_struct('h', {first}, 'out', cast(array() as array<bigint>))"
        return f"aggregate({over}, {held}, (acc, y) -> named_struct('h', {step('acc.h', 'y')}, 'out', concat(acc.out, array(acc.h))), acc -> acc.out)"

    blocks = "transform(sequence(0, cast((size(vals) - 1) div wide as int)), at -> slice(vals, at * wide + 1, wide))"
    firsts = fold(f"transform(parts, p -> aggregate(p, {start}, (h, y) -> {step('h', 'y')}))", start)
    whole = f"flatten(transform(parts, (p, i) -> {fold('p', 'get(firsts, i)')}))"
    inner = _let("parts", blocks, _let("firsts", firsts, whole))
    return f"if(size({values}) = 0, cast(array() as array<bigint>), {_let('vals', values, _let('wide', 'cast(ceil(sqrt(size(vals))) as int)', inner))})"


def _found(regex: str, needs: str | None) -> tuple[str, str]:
    """SQL of all matches, and of their structs (s, e, m, b, a), made from the matches `mm`: s and e in code points, m the match, b up to 40
    characters before it, a the one after it. Texts without the character that a match must hold are not scanned. The pieces between
    matches, as split cuts them, give all of this, so that the text itself is never counted through again."""
    quoted = regex.replace("\\", "\\\\").replace("'", "\\'")
    empty = f"cast(array() as array<{MATCH}>)"
    before = _running("transform(slice(ps, 1, size(mm)), (p, i) -> cast(length(p) + length(get(mm, i)) as bigint))", "0L", lambda h, y: f"{h} + {y}")
    left = "right(concat(right(coalesce(get(ps, i - 1), ''), 40), right(coalesce(get(mm, i - 1), ''), 40), right(get(ps, i), 40)), 40)"
    after = "left(concat(left(coalesce(get(ps, i + 1), ''), 1), left(coalesce(get(mm, i + 1), ''), 1)), 1)"
    made = f"transform(mm, (m, i) -> named_struct('s', get(pre, i) + length(get(ps, i)), 'e', get(pre, i) + length(get(ps, i)) + length(m), 'm', m, 'b', {left}, 'a', {after}))"
    places = _let("ps", f"split(text, '{quoted}')", _let("pre", before, made))
    matches = f"regexp_extract_all(text, '{quoted}', 0)"
    if needs:
        matches = f"if(contains(text, '{needs}'), {matches}, cast(array() as array<string>))"
    return matches, f"if(size(mm) = 0, {empty}, {places})"


DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
LUHN = (
    f"aggregate(transform(sequence(1, greatest(length({DIGITS}), 1)), i -> "
    f"coalesce(try_cast(substring(reverse({DIGITS}), i, 1) as int), 0) * if(i % 2 = 0, 2, 1)), 0, (a, d) -> a + if(d > 9, d - 9, d)) % 10 = 0"
)
OCTETS = "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(p as int), if(ltrim('0', p) = '', 0, cast(right(p, 3) as int))) <= 255)"
VALID = {
    "email": "true",
    "ip": OCTETS,
    "card": f"length({DIGITS}) between 16 and 19 and {LUHN}",
    "phone": f"length({DIGITS}) between 8 and 15",
}


def _votes(kind: str) -> list[str]:
    """SQL of each labeler's vote on span x of this kind: 1 for, -1 against, 0 no opinion."""
    strict = "if(x.base, 1, 0)"
    if kind == "email":
        form = "if(x.m rlike '^[^@\\\\s]+@[^@\\\\s]+$', 1, if(x.m rlike '[\\\\[({]', 0, -1))"
        known = f"if(lower(regexp_extract(x.m, '([A-Za-z0-9-]+)$', 1)) in ({', '.join(repr(t) for t in TLDS)}), 1, -1)"
    elif kind == "ip":
        form = "if(x.m like '%:%', if(x.m rlike '^[23][0-9A-Fa-f]{3}:', 1, -1), if(x.m rlike '(^|[.])0[0-9]', -1, 1))"
        known = f"if(lower(x.m) rlike '{NO_ONES}', -1, 0)"
    elif kind == "card":
        form = f"if({LUHN}, 1, -1)"
        known = f"if({DIGITS} rlike '{ISSUERS}', 1, -1)"
    else:
        form = "if(x.m rlike '[0-9][\\\\x20().-]+[0-9]', 1, 0)"
        codes = "|".join(CALLING)
        known = f"if(x.m like '+%' or x.m like '00%', if({DIGITS} rlike '^(00)?({codes})', 1, -1), if({DIGITS} rlike '^1?[2-9][0-9]{{2}}[2-9]', 1, -1))"
    q = lambda r: r.replace("\\", "\\\\")
    context = f"if(x.b rlike '{q(CONTEXT[kind])}', 1, if(x.b rlike '{q(AGAINST)}', -1, 0))"
    bounds = "if(x.b rlike '[A-Za-z0-9_]$' or x.a rlike '[A-Za-z0-9_]', -1, 1)"
    return [strict, form, known, context, bounds]


def _features(kind: str) -> str:
    """SQL of the features of span x that the final classifier sees: its own form and its surroundings, not the votes."""
    sign = lambda c: f"case when {c} = '' or {c} rlike '[\\\\s]' then 0 when {c} rlike '[A-Za-z0-9_]' then 1 when {c} rlike '[\\\\[({{<\"\\']' then 2 else 3 end"
    q = lambda r: r.replace("\\", "\\\\")
    parts = [
        "cast(least(5, length(x.m) div 6) as int)",
        "case when x.m rlike '[\\\\[({]' then 3 when x.m rlike '[ ]' then 2 when x.m rlike '[.-]' then 1 else 0 end",
        sign("right(x.b, 1)"),
        sign("x.a"),
        f"cast(least(2, size(array_distinct(split({DIGITS}, ''))) div 4) as int)",
        f"case when x.b rlike '{q(CONTEXT[kind])}' then 3 when x.b rlike '{q(AGAINST)}' then 2 when x.b rlike '[:=]\\\\s*$' then 1 else 0 end",
    ]
    return f"array({', '.join(parts)})"


def _free() -> str:
    """SQL of the candidates that overlap no base span. All spans are sorted by place, candidates by their ends; a candidate is free if
    none of the base spans that start before its end reaches beyond its start."""
    both = ["transform(bases, x -> named_struct('at', x.s, 'late', 1, 'k', -1, 'x', x))"]
    both += [f"transform(w_{kind}, x -> named_struct('at', x.e, 'late', 0, 'k', {n}, 'x', x))" for n, kind in enumerate(KINDS)]
    reach = _running("transform(ev, v -> if(v.k < 0, v.x.e, -1L))", "-1L", lambda h, y: f"greatest({h}, {y})")
    return _let("ev", f"array_sort(concat({', '.join(both)}))", _let("far", reach, "filter(ev, (v, i) -> v.k >= 0 and get(far, i) <= v.x.s)"))


def _spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): base spans and candidates of each row with their votes and features. One pass over the texts, nothing shuffled."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # a text without a digit or an at sign can hold no span
    out = out.withColumn("t", F.when(F.col("text").rlike(r"[0-9@]|[\[({]at[\])}]"), F.col("text")).otherwise(F.lit("")))
    out = out.select("doc_id", F.col("t").alias("text"))
    cols = {}
    for kind in KINDS:
        for what, regex, needs in (("b", BASE[kind], NEEDS[kind]), ("w", WIDE[kind], None)):
            matches, places = _found(regex, needs)
            out = out.withColumn(f"{what}m_{kind}", F.expr(matches))
            cols[f"{what}_{kind}"] = F.expr(re.sub(r"\bmm\b", f"{what}m_{kind}", places))
    out = out.withColumns(cols)
    out = out.withColumns({f"b_{k}": F.expr(f"filter(b_{k}, x -> {VALID[k]})") for k in KINDS})
    out = out.withColumn("bases", F.expr("concat(" + ", ".join(f"b_{k}" for k in KINDS) + ")"))
    none = f"cast(array() as array<struct<at:bigint,late:int,k:int,x:{MATCH}>>)"
    out = out.withColumn("free", F.expr(f"if({' + '.join(f'size(w_{k})' for k in KINDS)} = 0, {none}, {_free()})"))
    parts = []
    for n, kind in enumerate(KINDS):
        span = "named_struct('s', {0}.s, 'e', {0}.e, 'm', {0}.m, 'b', {0}.b, 'a', {0}.a, 'base', {1})"
        both = f"concat(transform(b_{kind}, x -> {span.format('x', 'true')}), transform(filter(free, f -> f.k = {n}), f -> {span.format('f.x', 'false')}))"
        parts.append(f"transform({both}, x -> named_struct('k', {n}, 's', x.s, 'e', x.e, 'base', x.base, 'v', array({', '.join(_votes(kind))}), 'f', {_features(kind)}))")
    return out.select("doc_id", F.expr(f"cast(concat({', '.join(parts)}) as {SPAN})").alias("spans"))


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over vote patterns of one kind: the share of true spans, each labeler's chances of each vote given
    false and true spans, and each pattern's probability of being true. It starts from the votes' majority."""
    post = {p: 1 / (1 + math.exp(-1.5 * sum(p))) for p in counts}
    prior, chance = 0.5, []
    for _ in range(rounds if counts else 0):
        n1 = sum(c * post[p] for p, c in counts.items())
        n0 = sum(c * (1 - post[p]) for p, c in counts.items())
        prior = (n1 + 1) / (n0 + n1 + 2)
        chance = []
        for j in range(LABELERS):
            votes = {}
            for v in (-1, 0, 1):
                a1 = sum(c * post[p] for p, c in counts.items() if p[j] == v)
                a0 = sum(c * (1 - post[p]) for p, c in counts.items() if p[j] == v)
                # pseudo-counts hold the belief that votes for a span are likelier on true ones, so that the classes can't change places
                votes[v] = ((a0 + (2, 2, 1)[v + 1]) / (n0 + 5), (a1 + (1, 2, 2)[v + 1]) / (n1 + 5))
            chance.append(votes)
        for p in counts:
            z = math.log(prior / (1 - prior)) + sum(math.log(chance[j][p[j]][1] / chance[j][p[j]][0]) for j in range(LABELERS))
            post[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
    return prior, chance, post


def classifier(sums: dict[tuple[int, ...], tuple[float, float]], steps: int = 400) -> list[list[float]]:
    """Logistic regression on the span features alone: sums holds (spans, sum of their posteriors) by feature values. Returns the bias as a
    list of its own, then a weight for each value of each feature."""
    w = [[0.0], *[[0.0] * n for n in FEATURES]]
    total = sum(c for c, _ in sums.values())
    rows = [((0, *f), c / total, p / c) for f, (c, p) in sums.items()] if total else []
    for _ in range(steps):
        grad = [[1e-3 * x for x in part] for part in w]
        for at, share, p in rows:
            z = sum(part[i] for part, i in zip(w, at))
            d = (1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) - p) * share
            for part, i in zip(grad, at):
                part[i] += d
        w = [[a - 1.5 * g for a, g in zip(part, more)] for part, more in zip(w, grad)]
    return w


def _table(values: list) -> str:
    return "array(" + ", ".join(_table(v) if isinstance(v, list) else f"{v:.9g}D" for v in values) + ")"


def find_pii(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, and spans, an array of structs (k: place in KINDS, s, e: code points, end exclusive,
    base) by k, then s.

    Base spans (the fixed expressions and checks) always stay. Other candidates that overlap none of them stay if the classifier, which
    learns the votes' posteriors from features of the spans, gives them at least 0.5 and at least one labeler beyond their bounds
    speaks for them. All counts are over all rows; the driver sees at most 3^5 vote patterns and 4,608 feature patterns a kind.
    Null and empty texts have no spans; repeated rows are all looked at; an empty table gives an empty one; other columns are not
    looked at. Work grows with a text's length, and with its matches to the power 1.5."""
    held = written(_spans(docs), "spans")
    spans = held.select(F.explode("spans").alias("x"))
    rows = spans.groupBy("x.k", "x.v").agg(F.count("*").alias("n")).collect()  # groups: 4 kinds times 3^5 patterns at most
    chances = [[0.0] * 3**LABELERS for _ in KINDS]
    for kind in range(len(KINDS)):
        _, _, post = reliabilities({tuple(r["v"]): r["n"] for r in rows if r["k"] == kind})
        for pattern, p in post.items():
            chances[kind][sum((v + 1) * 3**j for j, v in enumerate(pattern))] = p
    pattern = " + ".join(f"(x.v[{j}] + 1) * {3**j}" for j in range(LABELERS))
    likely = F.expr(f"{_table(chances)}[x.k][{pattern}]")
    sums = spans.groupBy("x.k", "x.f").agg(F.count("*").alias("n"), F.sum(likely).alias("p")).collect()  # 4 kinds times 4,608 patterns at most
    weights = [classifier({tuple(r["f"]): (r["n"], r["p"]) for r in sums if r["k"] == kind}) for kind in range(len(KINDS))]
    w = _table(weights)
    terms = " + ".join([f"{w}[x.k][0][0]"] + [f"{w}[x.k][{j + 1}][x.f[{j}]]" for j in range(len(FEATURES))])
    stays = f"x.base or ({terms} >= 0D and (x.v[1] = 1 or x.v[2] = 1 or x.v[3] = 1))"
    kept = f"array_sort(transform(filter(spans, x -> {stays}), x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'base', x.base)))"
    return held.select("doc_id", F.expr(kept).alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns of find_pii's result."""
    names = "array('email', 'ip', 'card', 'phone')"
    line = f"x -> concat({names}[x.k], ':', x.s, ':', x.e)"
    return spans.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, x -> x.base and x.k = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(F.expr(f"array_join(transform(filter(spans, x -> x.base), {line}), ',')").cast("binary"), 256).alias("base_sha256"),
        F.expr(f"array_join(transform(spans, {line}), ',')").alias("spans"),
        F.expr("cast(size(spans) as bigint)").alias("n_spans"),
    )
