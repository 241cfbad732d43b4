"""The operators as registered queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conflux.llm.collocations import collocations
from conflux.llm.decontaminate import contamination
from conflux.llm.digest import with_next
from conflux.llm.embedding_copies import embedding_copies
from conflux.llm.hard_negatives import hard_negatives
from conflux.llm.langid import identify, train
from conflux.llm.line_dedup import SITES, without_boilerplate
from conflux.llm.mixing import mixed
from conflux.llm.simhash import near_copies
from conflux.llm.substrings import without_repeats
from conflux.llm.surrogates import replaced
from conflux.llm.token_count import Unigram, token_counts
from conflux.llm.url_rules import judged, rules_table
from conflux.sources.files import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


LINES_SQL = f"""
with lines as (
  select doc_id, source, n, line
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line,
               unnest(range(len(string_split(text, chr(10))))) as n from documents)),
common as (
  select line, min(struct_pack(a := doc_id, b := n)) as first
  from lines where trim(line) <> '' group by line having count(distinct source) >= {SITES}),
marked as (
  select l.doc_id, l.n, l.line, c.line is not null and struct_pack(a := l.doc_id, b := l.n) <> c.first as gone
  from lines l left join common c on l.line = c.line)"""


@query(
    LINES_SQL
    + """
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
       md5(coalesce(string_agg(line, chr(10) order by n) filter (not gone), '')) as kept_md5
from marked group by doc_id"""
)
def op1_line_dedup(spark, folder):
    found = without_boilerplate(table(spark, folder, "documents"))
    kept = F.md5(F.col("kept").cast("binary")).alias("kept_md5")
    return found.select("row.doc_id", "n_lines", "n_removed", kept)


@query()
def op2_digest(spark, folder):
    return with_next(table(spark, folder, "documents"))


@query()
def op3_token_counts(spark, folder):
    return token_counts(table(spark, folder, "documents"), Unigram.read())


@query()
def op4_simhash(spark, folder):
    found = near_copies(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query()
def op8_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = train(docs.where(~held_out))
    found = identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query()
def op9_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return mixed(docs).select("row.doc_id", "row.source", "slot", "position")


@query()
def op5_decontaminate(spark, folder):
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# The rules of the query.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

URL_SQL = """
with rules(action, host, path) as (values {rules}),
urls as (
  select page_id, url,
         case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages),
parts as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from urls),
fit as (
  select p.page_id, p.host, p.path, r.action, r.host || r.path as rule,
         row_number() over (partition by p.page_id order by length(r.host || r.path) desc) as n
  from parts p left join rules r
    on (p.host = r.host or p.host like '%.' || r.host) and starts_with(p.path, r.path))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from fit where n = 1
""".format(rules=", ".join(str((a, r.split("/", 1)[0], "/" + r.split("/", 1)[1])) for a, r in URL_RULES))


@query(URL_SQL)
def op6_url_rules(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    found = judged(pages, rules_table(spark, URL_RULES))
    return found.select("row.page_id", "host", "path", "rule", "verdict")


# Any secret text; a corpus that is to keep its surrogates from run to run keeps its key.
SURROGATE_KEY = "the key of the registered query"


@query()
def op7_surrogates(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return replaced(docs, SURROGATE_KEY).select("row.doc_id", "n_mentions", F.col("safe").alias("text"))


@query()
def op10_substrings(spark, folder):
    return without_repeats(table(spark, folder, "documents"))


PHRASES_SQL = """
with pieces as (
  select row_number() over () as p, lang, regexp_extract_all(piece, '[^ \t]+') as words
  from (select coalesce(lang, 'und') as lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\n\x0B\f\r]')) as piece from documents)),
sizes as (select unnest(range(1, 5)) as size),
counts as (
  select lang, words, count(*) as f
  from (select lang, unnest(list_transform(range(1, len(words) - size + 2), lambda i: list_slice(words, i, i + size - 1))) as words
        from pieces, sizes where len(words) >= size)
  group by lang, words having count(*) >= 30 or len(words) = 1),
totals as (select lang, sum(f) as n from counts where len(words) = 1 group by lang),
cuts as (
  select lang, words, f, unnest(range(1, len(words))) as k from counts where len(words) > 1 and f >= 30),
scored as (
  select c.lang, c.words, c.f as a, k, l.f as l, r.f as r, 2000000::hugeint * c.f // (l.f + r.f) as score
  from cuts c join counts l on l.lang = c.lang and l.words = list_slice(c.words, 1, k)
  join counts r on r.lang = c.lang and r.words = list_slice(c.words, k + 1, len(c.words))),
best as (select * from scored qualify row_number() over (partition by lang, words order by score, k) = 1),
around as (
  select lang, inner_words, max(f) as f
  from (select lang, f, unnest([list_slice(words, 1, len(words) - 1), list_slice(words, 2, len(words))]) as inner_words
        from counts where len(words) > 2 and f >= 30)
  group by lang, inner_words),
kept as (
  select b.lang, array_to_string(b.words, ' ') as phrase, a, l, r, score
  from best b left join around o on o.lang = b.lang and o.inner_words = b.words
  where coalesce(100 * o.f < 80 * a, true))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r,
       n::bigint as n, score::bigint as score
from kept join totals using (lang)
qualify rank <= 2000
"""


@query(PHRASES_SQL)
def op11_collocations(spark, folder):
    return collocations(table(spark, folder, "documents"))


VECTORS_SQL = """
with recursive usable as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select a.vec_id as u, b.vec_id as v from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.98),
reached(vec_id, other) as (
  select vec_id, vec_id from embeddings union select r.vec_id, p.v from reached r join pairs p on p.u = r.other)
select e.vec_id, (select count(*) from pairs where u = e.vec_id) as n_links, min(r.other) as component_id,
       e.vec_id = min(r.other) as kept
from embeddings e join reached r on r.vec_id = e.vec_id group by e.vec_id
"""


@query(VECTORS_SQL)
def op12_embedding_copies(spark, folder):
    return embedding_copies(table(spark, folder, "embeddings"))


NEGATIVES_SQL = """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from usable a join usable b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id))::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives p join scores s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""


@query(NEGATIVES_SQL)
def op13_hard_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings").withColumn("label", label))
