"""One checked query for each operator, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrain.llm import (decontaminate, exact_dedup, hard_negatives, language_id, mixing, near_dup, packing, prefix_trie, secret_scan, token_count, toxicity,
                            training_order, url_filter)
from pulsegrain.llm.common import crc_mod, table
from pulsegrain.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_matches(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.sort_array("found.items"), ",")
    return found.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("bigint").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op2_decontaminate"] = f"""
with d as (select doc_id, coalesce({WORDS.format('text')}, []) as w from documents),
items as (select cast(item_id as varchar) as item, coalesce({WORDS.format('text')}, []) as w from benchmark),
windows as (select distinct item, array_to_string(w[t : t + 9], ' ') as win, least(len(w), 10) as n
  from items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as u(t) where len(w) > 0),
lengths as (select distinct n from windows),
spots as (select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as win
  from d, lengths, unnest(range(1, len(w) - n + 2)) as u(p)),
found as (select doc_id, p, s.n, item from spots s join windows v on s.win = v.win and s.n = v.n),
hits as (select doc_id, count(distinct q) as n_hit from (select distinct doc_id, p, n from found), unnest(range(p, p + n)) as u(q) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from found) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits on hits.doc_id = d.doc_id left join named on named.doc_id = d.doc_id"""


URL_RULES = [
    url_filter.host_rule("allow", "com/"),
    url_filter.host_rule("block", "example.com/en/"),
    url_filter.host_rule("allow", "www.example.com/en/"),
    url_filter.host_rule("block", "net/es/"),
    url_filter.host_rule("block", "net/fr/"),
    url_filter.pattern_rule("block", r"^([^/]*[.-])?cheap-pills\.", "cheap", "pills"),
    url_filter.pattern_rule("block", r"^([^/]*[.-])?spam-farm\.", "spam", "farm"),
    url_filter.pattern_rule("block", r"^[^/]*-casino[.-]", "casino"),
    url_filter.pattern_rule("block", r"^([^/]*\.)?ads?[0-9]*\."),
    url_filter.pattern_rule("block", r"/wp-(login|admin)\.php$", "wp", "php"),
]


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


# The contract's rules, longest first, and then the method's own, written out once more.
ORACLE["op4_url_filter"] = r"""
with a as (select page_id, strpos(coalesce(url, ''), '://') as pos, url from pages),
b as (select page_id, case when pos > 0 then substr(url, pos + 3) else '' end as rest from a),
c as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw_host from b),
p as (select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from c),
r as (select *, case
  when (host = 'www.example.com' or suffix(host, '.www.example.com')) and prefix(path, '/en/') then 'www.example.com/en/'
  when (host = 'example.com' or suffix(host, '.example.com')) and prefix(path, '/en/') then 'example.com/en/'
  when (host = 'net' or suffix(host, '.net')) and prefix(path, '/es/') then 'net/es/'
  when (host = 'net' or suffix(host, '.net')) and prefix(path, '/fr/') then 'net/fr/'
  when (host = 'com' or suffix(host, '.com')) and prefix(path, '/') then 'com/' end as rule from p)
select page_id, host, path, rule, case
  when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' when rule is not null then 'allow'
  when regexp_matches(host || path, '^([^/]*[.-])?(cheap-pills|spam-farm)\.') or regexp_matches(host || path, '^[^/]*-casino[.-]')
    or regexp_matches(host || path, '^([^/]*\.)?ads?[0-9]*\.') or regexp_matches(path, '/wp-(login|admin)\.php$') then 'block'
  else 'allow' end as verdict from r"""


@query
def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.with_copies(docs, {k: k for k in ("size", "source_size", "target", "copies")})
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, work_dir(spark, "digest-index"), buckets=12)
    out = index.admit(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE["op8_exact_dedup"] = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))"""


@query
def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_dup.classes(docs, near_dup.Settings(words=2))
    return out.select("row.doc_id", "n_shingles", "component_id", F.col("row.doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def joined_spans(spans: str, *kinds: str):
    """kind:start:end of the spans (of some kinds), comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secret_scan.BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return docs.select("doc_id", *(count(k) for k in base), F.sha2(joined_spans("spans", *base), 256).alias("base_sha256"),
                       joined_spans("spans").alias("spans"))


@query
def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, token_count.load_pieces()).select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "n_tokens")


def held_out(divisor: int, remainder: int, doc_id: str = "doc_id"):
    """Rows that nothing is learned from; a NULL id is not held out, and the operators do not learn from it either."""
    return F.coalesce(crc_mod(F.col(doc_id), divisor) == remainder, F.lit(False))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(~held_out(4, 2)))
    out = language_id.predict(docs.drop("lang"), model)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), F.col("predicted.lang").alias("lang_pred"), "predicted.score")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = toxicity.score(docs, labels, ~held_out(5, 0, "id"), held_out(5, 4, "id"))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return training_order.materialise(docs, work_dir(spark, "shards"))


@query
def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces).select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", "offset")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, F.col("id") % 50 == 0)


ORACLE["op12_hard_negatives"] = """
with r as (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_dot_product(a.q, b.q) as bigint) as score
  from r a, r b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
pos as (select anchor_id, other as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
neg as (select p.*, other as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, other) as n
  from pos p join s on s.anchor_id = p.anchor_id and not same
  where 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, cast(n as integer) as rank, negative_id, positive_score, negative_score from neg where n <= 3"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered(prefix_trie.turn_keys(table(spark, sf_dir, "conversations")))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 5, shared, 8))


# A cyclic redundancy check bit by bit, as this SQL has none; then prefixes as lists, and subtrees by comparing them.
ORACLE["op13_prefix_trie"] = """
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
c as (select conv_id, list({'r': role, 't': text} order by turn nulls first, sha256(strlen(role) || ':' || role || text)) as own from t group by conv_id),
bits as (select *, flatten(list_transform(range(1, length(conv_id::varchar) + 1), lambda i:
    list_transform(range(0, 8), lambda j: (ascii(substr(conv_id::varchar, i, 1)) >> j::integer) & 1))) as bits from c),
h as (select conv_id, own, xor(list_reduce(list_transform(bits, lambda x: x::bigint), lambda a, b:
    xor(a >> 1, case when xor(a, b) & 1 = 1 then 3988292384 else 0 end), 4294967295), 4294967295) % 9 as h from bits),
r as (select h.conv_id, list_concat(coalesce(list_slice(b.own, 1, h.h), []), list_slice(h.own, h.h + 1, len(h.own))) as path
  from h left join c b on b.conv_id = h.conv_id - h.conv_id % 5),
m as (select conv_id, d, list_slice(path, 1, d) as p, d = len(path) as ends from r, unnest(range(0, len(path) + 1)) as u(d)),
n as (select p, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, case when any_value(d) = 0 then 0 else (count(*) - 1) * strlen(p[len(p)].t) end as saved,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from m group by p),
k as (select n.*, (select min(conv_id) from n u where n.depth > 0 and u.depth = n.depth - 1 and u.p = list_slice(n.p, 1, n.depth - 1)) as parent_conv_id,
  (select count(*) from n v where v.depth = n.depth + 1 and list_slice(v.p, 1, n.depth) = n.p) as n_children from n),
s as (select a.p, sum(case when b.n_children = 0 then 1 else 0 end) as n_leaves, sum(b.saved) as saved_tokens
  from (select k.*, list_slice(p, 1, j) as above from k, unnest(range(0, depth + 1)) as u(j)) b join k a on a.p = b.above group by a.p)
select conv_id, depth, parent_conv_id, n_convs, n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, ends_sha256
from k join s on s.p = k.p"""
