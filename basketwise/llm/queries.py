"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketwise.llm import contamination, conversation_trie, embedding_dedup, jaccard_join, language_id, merkle, packing, pii, quality, secret_ownership, sharding, url_reputation, warc
from basketwise.llm.common import ship, table
from basketwise.llm.numbering import numbered
from basketwise.session import materialise, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        @functools.wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op2_slot_sharding")
def slot_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(table(spark, folder, "documents"), "doc_id", "text", 40, work_dir(spark, "slot-map"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op4_language_id")
def language(spark: SparkSession, folder: str) -> DataFrame:
    """A document without an id is neither learnt from nor held out; it is labelled like the others."""
    documents = table(spark, folder, "documents")
    model = language_id.learn(documents.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    labelled = language_id.label(documents, model, spans=False)
    return labelled.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query(
    "op6_warc_salvage",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
    f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM d LEFT JOIN f USING (payload_digest)""",
)
def warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    path = work_dir(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.page_records(warc.read_archives(spark, path))


URL_RULES = [
    url_reputation.Rule("allow", "com", "/"),
    url_reputation.Rule("block", "example.com", "/en/"),
    url_reputation.Rule("allow", "www.example.com", "/en/"),
    url_reputation.Rule("block", "net", "/es/"),
    url_reputation.Rule("block", "net", "/fr/"),
]


def page_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """(host, bad) of the labelled documents that pages carry; the last part of a page's path starts with its document's id."""
    path = url_reputation.path_of(F.col("url"))
    carried = table(spark, folder, "pages").select(
        url_reputation.host_of(F.col("url")).alias("host"), F.regexp_extract(path, r"/([0-9]+)[^/]*/?$", 1).try_cast("long").alias("doc_id")
    )
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, folder, "labels").select("doc_id", bad.alias("bad"))
    return carried.where("doc_id IS NOT NULL").join(labels, "doc_id").select("host", "bad")


_PARSED = """SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
      coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages"""
_TWO = ", ".join(f"'{s}'" for s in url_reputation.TWO_LEVEL)
_LAST = "array_to_string(list_slice(string_split(host, '.'), -{n}, -1), '.')"
_ICC = """(SELECT 1 / least(greatest(CASE WHEN sum(n * (n - 1) * mu * (1 - mu)) > 0
      THEN sum(pow(k - n * mu, 2) - n * mu * (1 - mu)) / sum(n * (n - 1) * mu * (1 - mu)) ELSE 0.001 END, 0.001), 0.999) - 1 FROM {t})"""


@query(
    "op10_url_reputation",
    f"""WITH parsed AS ({_PARSED}),
    named AS (SELECT *, {_LAST.format(n=2)} AS two, {_LAST.format(n=3)} AS three, {_LAST.format(n=1)} AS one FROM parsed),
    keyed AS (SELECT page_id, host, path, CASE WHEN two IN ({_TWO}) THEN three ELSE two END AS domain,
      CASE WHEN two IN ({_TWO}) THEN two ELSE one END AS suffix, try_cast(regexp_extract(path, '/([0-9]+)[^/]*/?$', 1) AS BIGINT) AS doc_id FROM named),
    hosts AS (SELECT host, domain, suffix, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (quality = 0 OR toxic = 1) AS DOUBLE) AS k
      FROM keyed JOIN labels USING (doc_id) WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY ALL),
    total AS (SELECT coalesce(sum(k) / sum(n), 0) AS rate FROM hosts),
    s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(rate) AS mu FROM hosts, total GROUP BY suffix),
    sm AS (SELECT {_ICC.format(t="s0")} AS m),
    s1 AS (SELECT suffix, (k + m * mu) / (n + m) AS mu FROM s0, sm),
    d0 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(mu) AS mu FROM hosts JOIN s1 USING (suffix) GROUP BY domain),
    dm AS (SELECT {_ICC.format(t="d0")} AS m),
    d1 AS (SELECT domain, (k + m * mu) / (n + m) AS mu FROM d0, dm),
    h0 AS (SELECT host, n, k, mu FROM hosts JOIN d1 USING (domain)),
    hm AS (SELECT {_ICC.format(t="h0")} AS m),
    post AS (SELECT host, k + m * mu AS a, n - k + m * (1 - mu) AS b FROM h0, hm),
    judged AS (SELECT page_id, host, path, domain,
      coalesce(a, CASE WHEN d1.mu IS NULL THEN 1 ELSE m END * coalesce(d1.mu, s1.mu, rate)) AS a,
      coalesce(b, CASE WHEN d1.mu IS NULL THEN 1 ELSE m END * (1 - coalesce(d1.mu, s1.mu, rate))) AS b
      FROM keyed LEFT JOIN post USING (host) LEFT JOIN d1 USING (domain) LEFT JOIN s1 USING (suffix), hm, total),
    ruled AS (SELECT *, CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
      a / (a + b) AS mean FROM judged),
    bound AS (SELECT *, round(mean - {url_reputation.Z} * sqrt(mean * (1 - mean) / (a + b + 1)), 6) AS lower_bound FROM ruled)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
      WHEN lower_bound > {url_reputation.THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict, round(mean, 6) AS bad_rate, lower_bound FROM bound""",
)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_reputation.judge(table(spark, folder, "pages"), page_outcomes(spark, folder), URL_RULES)


PII_KEY = "basketwise"


@query("op5_feistel_pii")
def feistel_pii(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymise(documents, PII_KEY, kinds="kinds")


@query("op1_sum_of_squares_packing")
def packed_documents(spark: SparkSession, folder: str) -> DataFrame:
    cut = materialise(packing.pieces(table(spark, folder, "documents")), "pieces")
    return packing.pack(cut)


_WORDS = (
    "coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
)


@query(
    "op7_positional_decontamination",
    f"""WITH d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
    i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
    lens AS (SELECT DISTINCT least(len(w), 10) AS n FROM i WHERE len(w) > 0),
    wins AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS win
      FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s) WHERE len(w) > 0),
    dw AS (SELECT doc_id, text, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
      FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(s)),
    hits AS (SELECT DISTINCT doc_id, text, s, dw.n, item_id FROM dw JOIN wins USING (n, win)),
    pos AS (SELECT doc_id, text, count(DISTINCT s + k) AS n_hit FROM hits, unnest(range(0, n)) AS u(k) GROUP BY ALL),
    its AS (SELECT doc_id, text, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY ALL)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN pos USING (doc_id, text) LEFT JOIN its USING (doc_id, text)""",
)
def decontaminated(spark: SparkSession, folder: str) -> DataFrame:
    marked = contamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return marked.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op3_int8_embedding_dedup")
def embedding_classes(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query("op8_weak_label_quality")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    votes = materialise(quality.voted(documents), "votes")
    model, scorer = quality.train(documents, votes)
    return quality.score(documents, scorer).select("doc_id", "score", (F.col("score") >= 0.5).alias("keep"))


@query("op9_count_vector_jaccard")
def jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, folder, "documents"))


#: The unsigned CRC-32 of a decimal number, bit by bit, in SQL.
_CRC32 = """xor(4294967295, list_reduce(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda r, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(r, b)),
      CAST(4294967295 AS BIGINT)))"""
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"


def _levels(name: str, first: str) -> str:
    """All levels of the trees whose leaves are (tree, lvl, idx, n, h)."""
    return f"""{name} AS ({first} UNION ALL SELECT tree, lvl + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
      FROM {name} WHERE n > 1 GROUP BY tree, lvl, idx // 2)"""


def _fold(name: str, first: str, levels: str) -> str:
    """Steps of rows (id, tree, lvl, idx, n, own, proof) up to the roots of their trees."""
    return f"""{name} AS ({first} UNION ALL SELECT f.id, f.tree, f.lvl + 1, f.idx // 2, (f.n + 1) // 2,
      sha256(CASE WHEN f.idx % 2 = 0 THEN f.own || coalesce(s.h, '') ELSE s.h || f.own END), f.proof || coalesce(s.h, '')
      FROM {name} f LEFT JOIN {levels} s ON s.tree = f.tree AND s.lvl = f.lvl AND s.idx = xor(f.idx, 1) WHERE f.n > 1)"""


_TREES = _levels("nodes", "SELECT tree, 0 AS lvl, idx, n, leaf AS h FROM numbered")
_TOP = _levels("tops", "SELECT 0 AS tree, 0 AS lvl, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, h FROM nodes WHERE n = 1")
_UP = _fold("up", "SELECT id, tree, 0 AS lvl, idx, n, altered AS own, '' AS proof FROM numbered", "nodes")
_OVER = _fold("over", "SELECT id, 0 AS tree, 0 AS lvl, t.idx, t.n, own, proof FROM up JOIN named t ON t.name = up.tree WHERE up.n = 1", "tops")


@query(
    "op11_postorder_merkle_log",
    f"""WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF.format(n="n_chars")} AS leaf,
      CASE WHEN {_CRC32.format("doc_id")} % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} ELSE {_LEAF.format(n="n_chars")} END AS altered FROM documents),
    numbered AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id,
      row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
    {_TREES}, {_TOP}, {_UP},
    named AS (SELECT tree AS name, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, h AS subroot FROM nodes WHERE n = 1),
    {_OVER}
    SELECT doc_id, leaf, subroot, tops.h AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = tops.h AS verified
    FROM over JOIN numbered USING (id) JOIN named ON named.name = numbered.tree, tops WHERE over.n = 1 AND tops.n = 1""",
)
def merkle_proofs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col("n_chars") + 1 if c == 3 else f for c, f in enumerate(fields)]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = documents.select("doc_id", "lang", merkle.leaf(*fields).alias("digest"), F.when(tampered, merkle.leaf(*changed)).alias("altered"))
    made = merkle.manifest(materialise(leaves, "digests"), "doc_id", "lang")
    return merkle.proofs(made, "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def rebuilt_conversations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(conv, length) and (conv, depth, id, chars): the first turns of each hundred's conversation, then the own ones after as many."""
    conv, heads = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    said = table(spark, folder, "conversations").where(conv.isNotNull()).select(
        "conv_id", "turn", conversation_trie.turn_digest(F.col("role"), F.col("text")).alias("id"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars"),
    )
    own = materialise(numbered(said, "conv_id", "turn", "id"), "turns")
    known = own.where("index = 0").select("conv_id", "total", heads.alias("heads"), (conv - conv % 100).alias("base"))
    bases = known.where("conv_id = base").select("base", F.col("total").alias("offered"))
    taken = F.least("heads", F.coalesce("offered", F.lit(0)))
    members = known.join(bases, "base", "left").select("conv_id", "base", "heads", "total", taken.alias("taken"))
    members = materialise(members, "members")
    head = own.where((F.col("conv_id") % 100 == 0) & (F.col("index") < 5)).select(F.col("conv_id").alias("base"), "index", "id", "chars")
    first = members.join(head, "base").where("index < taken").select("conv_id", (F.col("index") + 1).alias("depth"), "id", "chars")
    rest = own.where(F.col("index") >= heads).select("conv_id", "index", "id", "chars").join(members, "conv_id")
    rest = rest.select("conv_id", (F.col("taken") + F.col("index") - F.col("heads") + 1).alias("depth"), "id", "chars")
    length = F.col("taken") + F.greatest(F.col("total") - F.col("heads"), F.lit(0))
    turns = first.union(rest).withColumnRenamed("conv_id", "conv")
    return members.select(F.col("conv_id").alias("conv"), length.cast("long").alias("length")), materialise(turns, "rebuilt")


_PREFIX = "array_to_string(list_slice(ids, 1, {}), ' ')"


@query(
    "op12_double_array_prefix_trie",
    f"""WITH said AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
      length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS idx FROM said),
    convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {_CRC32.format("conv_id")} % 6 AS h FROM own),
    turns AS (SELECT c.conv_id, 0 AS part, o.idx, o.id, o.chars FROM convs c JOIN own o ON o.conv_id = c.base AND o.idx < c.h
      UNION ALL SELECT conv_id, 1, idx, id, chars FROM own JOIN convs USING (conv_id) WHERE idx >= h),
    seqs AS (SELECT conv_id, coalesce(ids, []) AS ids, coalesce(lens, []) AS lens FROM convs LEFT JOIN
      (SELECT conv_id, list(id ORDER BY part, idx) AS ids, list(chars ORDER BY part, idx) AS lens FROM turns GROUP BY conv_id) USING (conv_id)),
    passed AS (SELECT conv_id, d, {_PREFIX.format("d")} AS k, CASE WHEN d > 0 THEN {_PREFIX.format("d - 1")} END AS up,
      CASE WHEN d > 0 THEN lens[d] ELSE 0 END AS chars, len(ids) = d AS ends FROM seqs, unnest(range(0, len(ids) + 1)) AS u(d)),
    node AS (SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(chars) AS saved,
      sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM passed GROUP BY d, k),
    kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY d, up),
    told AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, k)),
    below AS (SELECT a.d, a.k, sum(t.saved) AS saved, count(*) FILTER (t.n_children = 0) AS leaves FROM told t
      JOIN passed p ON p.conv_id = t.conv_id AND p.d <= t.d JOIN (SELECT d, k FROM told) a ON a.d = p.d AND a.k = p.k GROUP BY a.d, a.k)
    SELECT t.conv_id, t.d AS depth, u.conv_id AS parent_conv_id, t.n AS n_convs, t.n_children, b.leaves AS n_leaves,
      CAST(b.saved AS BIGINT) AS saved_tokens, t.ends_sha256 FROM told t JOIN below b USING (d, k) LEFT JOIN told u ON u.d = t.d - 1 AND u.k = t.up""",
)
def conversation_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.nodes(*rebuilt_conversations(spark, folder))


_GAPS = """{name} AS (SELECT id, t, regexp_extract_all(t, '{form}') AS m, string_split_regex(t, '{form}') AS g FROM docs),
    {name}_at AS (SELECT id, m[k] AS v, CAST(list_sum(list_transform(g[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a
      FROM {name}, unnest(range(1, len(m) + 1)) AS u(k))"""
_ASSIGN_SQL = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_VALUE_SQL = f"^{_ASSIGN_SQL.removesuffix('[A-Za-z0-9+/_.=-]+')}([A-Za-z0-9+/_.=-]+)$"


@query(
    "op13_secret_ownership",
    f"""WITH docs AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS t FROM documents),
    {_GAPS.format(name="assign", form=_ASSIGN_SQL)}, {_GAPS.format(name="access", form="AKIA[A-Z0-9]+")},
    {_GAPS.format(name="hexa", form="[0-9a-f]{24,}")}, {_GAPS.format(name="opaque", form="[A-Za-z0-9_-]{24,}")},
    base AS (SELECT id, a, 0 AS rank, a + length(v) AS b, regexp_extract(v, '{_VALUE_SQL}', 1) AS v FROM assign_at WHERE length(regexp_extract(v, '{_VALUE_SQL}', 1)) >= 6
      UNION ALL SELECT id, a, 1, a + length(v), v FROM access_at WHERE length(v) >= 20 UNION ALL SELECT id, a, 2, a + length(v), v FROM hexa_at),
    mixed AS (SELECT id, a, 3 AS rank, a + length(v) AS b, v FROM opaque_at WHERE regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')
      AND regexp_matches(v, '[0-9]') AND len(list_distinct(string_split(v, ''))) >= 12),
    cand AS (FROM base UNION ALL SELECT m.* FROM mixed m ANTI JOIN base ON base.id = m.id AND base.a < m.b AND m.a < base.b),
    held AS (SELECT DISTINCT v, coalesce(source, chr(0)) AS owner FROM cand JOIN docs USING (id)),
    counted AS (SELECT v, count(*) AS owners FROM held GROUP BY v),
    judged AS (SELECT id, rank, a, owners = 1 AS live, ['assign', 'access', 'hex', 'opaque'][rank + 1] || ':' || a || ':' || b AS span
      FROM cand JOIN counted USING (v) WHERE rank < 3 OR owners = 1),
    by_doc AS (SELECT id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
      string_agg(span, ',' ORDER BY a, rank) FILTER (rank < 3) AS based, string_agg(span, ',' ORDER BY a, rank) AS spans,
      count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM judged GROUP BY id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
    FROM docs LEFT JOIN by_doc USING (id)""",
)
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Sources are the owners, documents their repositories."""
    found = secret_ownership.scan(table(spark, folder, "documents"), "doc_id", "text", "doc_id", "source")
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_ownership.written(base), 256).alias("base_sha256"), secret_ownership.written(F.col("spans")).alias("spans"),
        "n_live", "n_example",
    )
