"""URL filter: rules on host and path, then a weighted vocabulary.

A url without a rule is judged by its words: an Aho-Corasick automaton finds the forms of strict and soft terms in the whole
url, query and fragment included; a hit counts only where no letter or digit stands beside it. One strict hit or several
hits of distinct soft terms block the url.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read

#: Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Vocabulary, terms with their forms in several languages: any strict term blocks, or SOFT_HITS distinct soft ones.
STRICT = {
    "casino": ("casino", "kasino"), "cialis": ("cialis",), "escorts": ("escorts",), "hentai": ("hentai",), "porn": ("porn", "porno", "pornos"),
    "sex": ("sex", "sexe", "sexo"), "viagra": ("viagra",), "warez": ("warez",), "xxx": ("xxx",),
}
SOFT = {
    "ads": ("ads", "adserver", "anuncios", "werbung"), "adult": ("adult", "adulte", "adultes", "adulto", "adultos", "erotik", "erotic", "erotico"),
    "bet": ("bet", "bets", "betting", "wette", "wetten", "apuesta", "apuestas"), "bonus": ("bonus", "bono", "bonos"),
    "cheap": ("cheap", "cheapest", "billig", "barato", "baratos"), "click": ("click", "clicks", "klick", "clic"), "crack": ("crack", "cracked", "keygen"),
    "dating": ("dating", "citas", "rencontre", "rencontres"), "escort": ("escort",), "farm": ("farm", "farms"),
    "free": ("free", "gratis", "gratuit", "gratuite", "kostenlos"), "girls": ("girl", "girls", "chicas", "filles"), "jackpot": ("jackpot", "jackpots"),
    "loan": ("loan", "loans", "kredit", "prestamo", "prestamos"), "lottery": ("lottery", "lotto", "loteria", "loterie"), "nude": ("nude", "nudes", "desnuda", "nackt"),
    "pills": ("pill", "pills", "pillen", "pilules", "pastillas"), "poker": ("poker",), "replica": ("replica", "replicas"), "roulette": ("roulette", "ruleta"),
    "slots": ("slot", "slots"), "spam": ("spam", "spams"), "torrent": ("torrent", "torrents"), "track": ("track", "tracker", "trackers"),
    "win": ("win", "wins", "winner", "gewinn", "ganar", "gagner"),
}
SOFT_HITS = 2


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path together) that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for own, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def automaton(strict=STRICT, soft=SOFT) -> ahocorasick.Automaton:
    """Of all forms, with their term and its weight (1: strict). A form that is in both is strict."""
    found = ahocorasick.Automaton()
    for weight, terms in enumerate((soft, strict)):
        for term, forms in terms.items():
            for form in forms:
                found.add_word(form, (len(form), term, weight))
    found.make_automaton()
    return found


def judge(text: str, found: ahocorasick.Automaton) -> tuple[int, int]:
    """Numbers of distinct strict and soft terms, of forms with no ASCII letter or digit beside them."""
    hits = {
        (term, weight)
        for end, (length, term, weight) in found.iter(text)
        if not (end + 1 < len(text) and text[end + 1].isascii() and text[end + 1].isalnum())
        and not (end >= length and text[end - length].isascii() and text[end - length].isalnum())
    }
    return sum(w for _, w in hits), sum(1 - w for _, w in hits)


def url_filter(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, n_strict, n_soft.

    Only page_id and url are read: further columns, whatever their names, play no part. Null urls are empty. Urls without
    `://` have an empty host and path and fit no rule, but their words are judged. Urls of any length are read whole. Of
    rules that fit, the longest (host and path together) wins; rules of one length that fit one url have one host, so
    none tie. Repeated rows give repeated results, empty tables none.
    """
    rows = pages.select(F.col("page_id").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("u"))
    host, path = split_url(F.col("u"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "u")

    def count(batches):
        found = automaton(strict, soft)
        for batch in batches:
            hits = [judge(u.lower(), found) for u in batch.column("u").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([h[0] for h in hits], pa.int32()), pa.array([h[1] for h in hits], pa.int32())],
                names=["page_id", "host", "path", "n_strict", "n_soft"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    rows = rows.mapInArrow(count, f"page_id {kind}, host string, path string, n_strict int, n_soft int")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= soft_hits), "block").otherwise("allow")
    return rows.withColumn("r", rule).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "n_strict", "n_soft")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))


def _oracle() -> str:
    """The same verdicts by regular expressions, term by term."""
    hit = lambda forms: f"cast(regexp_matches(u, '(^|[^a-z0-9])({'|'.join(forms)})([^a-z0-9]|$)') as int)"
    fits = lambda own, start: f"(host = '{own}' or host like '%.{own}') and starts_with(path, '{start}')"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    return f"""
with a as (select page_id, lower(coalesce(url, '')) as u, case when url is not null and position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
b as (select page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from a),
c as (select *, {" + ".join(map(hit, STRICT.values()))} as n_strict, {" + ".join(map(hit, SOFT.values()))} as n_soft,
  case {" ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in longest)} end as rule from b)
select page_id, host, path, rule,
  case {" ".join(f"when rule = '{h}{p}' then '{v}'" for h, p, v in longest)}
    when n_strict > 0 or n_soft >= {SOFT_HITS} then 'block' else 'allow' end as verdict, n_strict, n_soft
from c
"""


ORACLE = _oracle()
