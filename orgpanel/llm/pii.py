"""Personal data by weak supervision.

Base kinds (email, ip, card, phone) are what their patterns match. Wider patterns give further candidates: national numbers, local phone
numbers, spelled-out e-mail addresses, persons after a title. Labelers vote on each candidate, 1 for, -1 against, 0 abstain: a strict shape, a gazetteer of given names and mail words,
words of the context before it, a check of its digits, and counter-evidence in and around it. Candidates
with the same votes are counted over the whole corpus; expectation-maximisation on these counts (at most 3**5 rows, so
they fit the driver) estimates how reliable each labeler is. The posteriors train the final span classifier, a logistic
regression on the votes and on hashed features of its own, which no labeler sees: kind, shape and length of the match, the two words before it, the
word after it, and the characters beside it. It is fitted on at most ``sample`` candidates of each kind, those with the smallest hash (the documented bound); its weights are
applied to all as a column expression. Candidates that it accepts are spans of
their own kinds; base spans stay whatever it says.

Every text is read once; matches and their places come from ``regexp_extract_all`` and ``split`` with one pattern, so a place is the
length of all before it. Patterns use possessive loops: time and stack stay small on very long runs. Only DataFrame and SQL functions run on
rows.

Edge cases: null and empty texts have no spans and the digest of an empty string; rows that repeat a doc_id keep their own rows; a null
doc_id is kept; positions count code points; other columns are ignored; an empty table gives no rows; with no candidates nothing is added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgpanel.storage import materialize

LOCAL = "A-Za-z0-9._%+-"
#: kind -> (pattern, cheap condition on the text). A run is entered at its start, or where the last match ended.
BASE = {
    "email": (rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "text rlike '[0-9][.][0-9]'"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", "text rlike '[0-9][ -]?[0-9]'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')"),
}
WIDER = {
    "natid": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "text rlike '[0-9]-[0-9]'"),
    "localphone": (r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "text rlike '[0-9]{3}[)]?[ .-]'"),
    "spelledmail": (rf"(?<![{LOCAL}])[{LOCAL}]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]++)++", "contains(text, '(at)') or contains(text, '[at]') or contains(text, '(AT)') or contains(text, '[AT]')"),
    "person": (r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Sr|Sra)\.?\x20\p{Lu}\p{L}++(?:\x20\p{Lu}\p{L}++)?", r"text rlike '(Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Sr|Sra)[.]? '"),
}
KINDS = [*BASE, *WIDER]

# Given names of English, German, French and Spanish, and words of mail addresses; words that speak for or against personal data; words of what is no person.
NAMES = """adam alan albert alejandro alex alfred alice alicia amelie amy ana andrea andreas andrew angela anja ann anna anne anthony antoine antonio arthur barbara beatriz benjamin bernard bernd betty brian
camille carl carla carlos carmen carol caroline catherine charles charlotte chloe christian christine claire claudia clara cristina daniel david deborah diego dieter donald dorothy edward eduardo elena elisabeth elizabeth emily emma eric
ernst eva felix fernando florian francis francisco francois frank franz gabriel george gerard greta guillaume hans harry heike heinrich helen helena helga henri henry hugo ines ingrid isabel jack jacques james jan jane janet javier jean jennifer
jessica joan joe johann john jonas jorge jose joseph juan judith jules julia julie jurgen karen karin karl katharina kevin klaus laura lea leon linda lisa louis louise lucas lucia luis lukas manuel marc marco margaret maria marie mario mark markus martha martin mary
matthew max mia michael michel miguel monica monika nancy nicolas nicole nina olivier oscar pablo patricia patrick paul paula pedro peter petra philipp pierre rachel rafael raul rebecca richard robert roberto rosa ruth sabine samuel sandra sara sarah sebastian sergio simon
sofia sophie stefan stephanie stephen steven susan susanne teresa thomas tobias ulrich ursula uwe victor werner william wolfgang yves mail info contact"""
FOR = "phone|tel|call|mobile|fax|ssn|social|passport|born|contact|reach|write|mail|email|name|card|visa|telefon|anruf|llame|correo|appel|courriel|adresse|address"
AGAINST = "version|isbn|issn|page|chapter|figure|table|section|part no|serial|example only|rfc|order no|model|build|ticket"
NOBODY = "inc|corp|corporation|gmbh|ltd|street|avenue|hospital|university|institute|company|strasse|platz|rue|calle|school|clinic"


@dataclass(frozen=True)
class PiiConfig:
    context: int = 40
    rounds: int = 30
    accept: float = 0.5
    sample: int = 512
    bits: int = 10


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    """Sum of the digits of x (a string of digits), each second from the right doubled."""
    return f"aggregate(sequence(1, length({x})), 0, (a, i) -> a + if((length({x}) - i) % 2 = 0, cast(substring({x}, i, 1) as int), int(substring('0246813579', cast(substring({x}, i, 1) as int) + 1, 1)))) % 10 = 0"


#: Condition on the matched string m.
VALID = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(coalesce(nullif(right(ltrim('0', p), 3), ''), '0') as int) <= 255)",
    "card": _luhn(_digits("m")),
    "phone": f"length({_digits('m')}) between 9 and 15",
}


def _spans(kind: str, pattern: str, when: str) -> Column:
    """Array of (start, rank, kind, end, m) of all matches; empty where ``when`` fails."""
    found = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
    pieces = F.split(F.col("text"), pattern, -1)
    place = "transform(ps.m, (x, i) -> aggregate(slice(ps.p, 1, i + 1), 0, (a, y) -> a + length(y)) + aggregate(slice(ps.m, 1, i), 0, (a, y) -> a + length(y)))"
    made = F.when(F.expr(when), F.struct(found.alias("m"), pieces.alias("p")))
    rank = KINDS.index(kind)
    spans = f"zip_with(ps.m, {place}, (m, s) -> named_struct('start', s, 'rank', {rank}, 'kind', '{kind}', 'end', s + length(m), 'm', m))"
    return made, f"coalesce(filter({spans}, x -> {VALID.get(kind, 'true').replace('m)', 'x.m)').replace('(m,', '(x.m,')}), array())"


def _all_spans(texts: DataFrame) -> DataFrame:
    """doc_id, text, base and wider span arrays; overlaps of wider spans with base spans are left out."""
    out = texts
    for kind, (pattern, when) in {**BASE, **WIDER}.items():
        made, spans = _spans(kind, pattern, when)
        out = out.withColumn(f"p_{kind}", made)
        out = out.withColumn(f"s_{kind}", F.expr(spans.replace("ps.", f"p_{kind}.")))
    base, wider = ", ".join(f"s_{k}" for k in BASE), ", ".join(f"s_{k}" for k in WIDER)
    out = out.withColumn("base", F.expr(f"array_sort(concat({base}))"))
    return out.withColumn("wider", F.expr(f"filter(concat({wider}), x -> not exists(base, b -> b.start < x.end and x.start < b.end))")).select("doc_id", "text", "base", "wider")


def _votes(cfg: PiiConfig) -> str:
    """A candidate x of the text with its votes, as an array of -1, 0 and 1."""
    near = f"lower(substring(text, greatest(x.start - {cfg.context} + 1, 1), least(x.start, {cfg.context})))"
    after = f"lower(substring(text, x.end + 1, {cfg.context}))"
    names = "|".join(NAMES.split())
    shape = "case when x.kind in ('email', 'natid', 'spelledmail') then 1 when x.kind = 'ip' then 1 when x.kind = 'person' then if(x.m rlike '[.] ', 1, 0) when x.kind = 'phone' then if(x.m rlike '[(].*[)]', 1, 0) else 0 end"
    check = "case when x.kind in ('card', 'phone', 'ip') then 1 when x.kind = 'localphone' then if(substring(regexp_replace(x.m, '[^0-9]', ''), 1, 1) in ('0', '1'), -1, 0) when x.kind = 'natid' then if(x.m rlike '^(000|666|9)' or x.m rlike '-00-' or x.m rlike '-0000$', -1, 1) else 0 end"
    against = f"{near} rlike '({AGAINST})' or {after} rlike '^[^a-z]*({AGAINST}|{NOBODY})\\\\b' or (x.kind = 'person' and lower(x.m) rlike '\\\\b({NOBODY})\\\\b')"
    return f"array({shape}, if(lower(x.m) rlike '\\\\b({names})\\\\b', 1, 0), if({near} rlike '\\\\b({FOR})\\\\b', 1, 0), {check}, if({against}, -1, 0))"


def _features(cfg: PiiConfig) -> str:
    """Places of the classifier's own features of a candidate x."""
    near = f"lower(substring(text, greatest(x.start - {cfg.context} + 1, 1), least(x.start, {cfg.context})))"
    after = f"lower(substring(text, x.end + 1, {cfg.context}))"
    own = [
        "'kind', x.kind",
        r"'shape', x.kind, regexp_replace(regexp_replace(x.m, '[0-9]+', '9'), '\\p{L}+', 'a')",
        "'size', x.kind, cast(least((x.end - x.start) div 3, 12) as string)",
        rf"'before', regexp_extract({near}, '(\\p{{L}}+)[^\\p{{L}}]*$', 1)",
        rf"'second', regexp_extract({near}, '(\\p{{L}}+)[^\\p{{L}}]+\\p{{L}}+[^\\p{{L}}]*$', 1)",
        rf"'after', regexp_extract({after}, '^[^\\p{{L}}]*(\\p{{L}}+)', 1)",
        "'beside', substring(text, x.start, if(x.start > 0, 1, 0)), substring(text, x.end + 1, 1)",
    ]
    return f"array({', '.join(f'cast(pmod(xxhash64({x}), {1 << cfg.bits}) as int)' for x in own)})"


def estimate(counts: list[tuple[tuple[int, ...], int]], rounds: int) -> tuple[float, list[dict[tuple[int, int], float]], list[float]]:
    """EM over patterns of votes: prior, chance of each vote given the truth, posterior of each pattern.

    Starts from the votes: against if any is, else for if any is; chances are smoothed by one count.
    """
    post = [0.1 if min(v) < 0 else 0.9 if max(v) > 0 else 0.3 for v, _ in counts]
    prior, chance = 0.5, []
    for _ in range(rounds if counts else 0):
        total, yes = sum(n for _, n in counts), sum(n * p for (_, n), p in zip(counts, post))
        prior = (yes + 1) / (total + 2)
        chance = []
        for k in range(len(counts[0][0])):
            seen = {(y, v): 1.0 for y in (0, 1) for v in (-1, 0, 1)}
            for (votes, n), p in zip(counts, post):
                seen[1, votes[k]] += n * p
                seen[0, votes[k]] += n * (1 - p)
            chance.append({(y, v): c / sum(seen[y, x] for x in (-1, 0, 1)) for (y, v), c in seen.items()})
        post = []
        for votes, _ in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(c[1, v] / c[0, v]) for c, v in zip(chance, votes))
            post.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
    return prior, chance, post


def train(rows: list[tuple[list[int], list[int], float]], size: int, epochs: int = 40, rate: float = 0.3, decay: float = 1e-4) -> tuple[list[float], list[float]]:
    """Logistic regression by AdaGrad on (votes, places, truth): weights of the votes with the bias last, weights of the places."""
    votes = len(rows[0][0]) if rows else 0
    w, seen = [0.0] * (votes + 1 + size), [1e-3] * (votes + 1 + size)
    sparse = [([(i, float(v)) for i, v in enumerate(own) if v] + [(votes, 1.0)] + [(votes + 1 + p, 0.5) for p in places], y) for own, places, y in rows]
    for _ in range(epochs):
        for x, y in sparse:
            e = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] * v for i, v in x))))) - y
            for i, v in x:
                g = e * v + decay * w[i]
                seen[i] += g * g
                w[i] -= rate * g / math.sqrt(seen[i])
    return w[: votes + 1], [0.5 * x for x in w[votes + 1 :]]


def _numbers(values: list[float]) -> str:
    return f"array({', '.join(f'{v!r}D' for v in values)})"


def find_pii(docs: DataFrame, cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """doc_id, base and added span arrays (start, rank, kind, end, m, posterior, score) for every row of docs.

    posterior is what the labelers' votes give, score what the classifier gives.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    voted = f"transform(concat(base, wider), x -> named_struct('x', x, 'votes', {_votes(cfg)}, 'places', {_features(cfg)}))"
    found = materialize(_all_spans(texts).select("doc_id", F.expr(voted).alias("cand")), "spans")

    single = found.select(F.explode("cand").alias("c"))
    tally = single.groupBy("c.votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    prior, chance, post = estimate([(tuple(r.votes), r.n) for r in tally], cfg.rounds)
    truth = {tuple(r.votes): p for r, p in zip(tally, post)}
    first = Window.partitionBy("c.x.kind").orderBy(F.xxhash64("c.x.m", "c.places"), "c.x.m", "c.places", "c.votes")
    drawn = single.select("c", F.row_number().over(first).alias("r")).where(F.col("r") <= cfg.sample).orderBy("c.x.kind", "r").select("c.votes", "c.places").collect()
    dense, hashed = train([(r.votes, r.places, truth[tuple(r.votes)]) for r in drawn], 1 << cfg.bits)

    if drawn:
        odds = [f"case c.votes[{k}] when 1 then {math.log(p[1, 1] / p[0, 1])!r}D when 0 then {math.log(p[1, 0] / p[0, 0])!r}D else {math.log(p[1, -1] / p[0, -1])!r}D end" for k, p in enumerate(chance)]
        posterior = f"1 / (1 + exp(-({math.log(prior / (1 - prior))!r}D + {' + '.join(odds)})))"
        own = " + ".join([f"{dense[-1]!r}D", *(f"{a!r}D * c.votes[{k}]" for k, a in enumerate(dense[:-1]))])
        score = f"1 / (1 + exp(-({own} + aggregate(c.places, 0D, (a, p) -> a + {_numbers(hashed)}[p]))))"
    else:
        posterior = score = "0D"
    judged = f"transform(cand, c -> named_struct('start', c.x.start, 'rank', c.x.rank, 'kind', c.x.kind, 'end', c.x.end, 'm', c.x.m, 'posterior', {posterior}, 'score', {score}, 'named', exists(c.votes, v -> v > 0)))"
    out = found.select("doc_id", F.expr(judged).alias("s"))
    added = f"filter(s, x -> x.rank >= {len(BASE)} and x.named and x.score >= {cfg.accept}D)"
    return out.select("doc_id", F.expr(f"array_sort(filter(s, x -> x.rank < {len(BASE)}))").alias("base"), F.expr(added).alias("added"))


def pii_digests(docs: DataFrame, cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """The contract of op8, with the classifier's score and the votes' posterior of all spans."""
    joined = lambda spans: f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    listed = lambda field: F.expr(f"array_join(transform(array_sort(concat(base, added)), x -> format_number(x.{field}, 3)), ',')").alias(f"{field}s")
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    base = F.sha2(F.expr(joined("base")).cast("binary"), 256).alias("base_sha256")
    return find_pii(docs, cfg).select("doc_id", *counts, base, F.expr(joined("array_sort(concat(base, added))")).alias("spans"), listed("score"), listed("posterior"))
