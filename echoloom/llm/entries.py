"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from echoloom.llm.chat_format import digests, format_chats, gathered
from echoloom.llm.curriculum import curriculum, cyclic_schedules, word_count
from echoloom.llm.decontaminate import contamination
from echoloom.llm.importance import resample
from echoloom.llm.license_scan import SPELLINGS, WHOLE_DIGESTS, known_texts, license_scan
from echoloom.llm.language_id import held_out, identify, train
from echoloom.llm.minhash_forest import minhash_components
from echoloom.llm.onebit_ann import nearest
from echoloom.llm.piece_merges import decode_ids, encode_texts
from echoloom.llm.token_spans import section_tokens
from echoloom.llm.url_filter import url_verdicts
from echoloom.llm.warc_bundle import archive_folder, read_archive, write_archive
from echoloom.scratch import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


#: All pairs that share a shingle, and what can be reached by links.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[p + 1:p + 3], ' ') AS shingle FROM (SELECT *, unnest(range(0, greatest(len(words) - 2, least(len(words), 1)))) AS p FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM c JOIN n x ON c.i = x.doc_id JOIN n y ON c.j = y.doc_id WHERE 100 * common >= 85 * (x.n + y.n - common)),
ends AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT i, i AS other FROM ends UNION SELECT r.i, ends.j FROM r JOIN ends ON r.other = ends.i),
m AS (SELECT i, min(other) AS least FROM r GROUP BY i)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least, w.doc_id) AS component_id, coalesce(m.least, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN m ON w.doc_id = m.i"""


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations come in the ``messages`` layout, conversation -1 as prompt and response."""
    listed = gathered(table(spark, sf_dir, "conversations")).select("conv_id", F.struct("messages", F.lit(None).cast("string").alias("prompt"), F.lit(None).cast("string").alias("response")).alias("payload"))
    none = F.lit(None).cast(listed.schema["payload"].dataType["messages"].dataType)
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.struct(none.alias("messages"), F.lit(CONTROL_TEXT).alias("prompt"), F.lit(CONTROL_TEXT).alias("response")).alias("payload"))
    return digests(format_chats(listed.unionByName(extra)))


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(url_encode(role)) + 1
    + length(regexp_replace(replace(said, '\', '\\'), '([<\[])(/?(s>|INST\]))', '\1\\\2', 'g'))
    + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn NULLS FIRST, role, said)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(said) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN said ELSE '' END, '' ORDER BY turn NULLS FIRST, role, said)) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


#: Their integrals are the weights 5, 2 and 1: early sources fade, late ones rise.
SCHEDULES = ((8.0, 5.0, 2.0), (1.0, 2.0, 3.0), (0.5, 0.5, 2.5))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stored(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    mixed = curriculum(sized, cyclic_schedules(sized, SCHEDULES), share=1.5, most=2.0)
    first, last = (F.round(F.try_element_at("copies", F.lit(i))["position"], 6) for i in (1, -1))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"), last.alias("last_position"))


def _op3_sql() -> str:
    def turn(what: tuple[float, ...]) -> str:
        return "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 " + " ".join(f"WHEN {i} THEN {x}::DOUBLE" for i, x in enumerate(what)) + " END"

    def within(u: str, v: str, area: str) -> str:
        """The time after the start of a half at which its running integral reaches an area."""
        return f"least(({area}) / 0.5 * 2 / nullif({u} + sqrt(greatest({u} * {u} + ({v} - {u}) * (({area}) / 0.5) * 2, 0)), 0), 1.0) * 0.5"

    def position(words: str) -> str:
        area = f"(({words}) * weight / target)"
        half = "((u0 + u1) / 2 * 0.5)"
        return f"round(CASE WHEN {area} < {half} THEN {within('u0', 'u1', area)} ELSE 0.5 + coalesce({within('u1', 'u2', f'{area} - {half}')}, 0.5) END, 6)"

    return rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size,
    coalesce(md5(doc_id::VARCHAR), '') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS held FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * held AS cap, {turn((5.0, 2.0, 1.0))} AS weight,
    {", ".join(f"{turn(tuple(x[i] for x in SCHEDULES))} AS u{i}" for i in range(3))} FROM s),
l AS (SELECT *, 1.5::DOUBLE * (sum(held) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0) AS remaining,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(place) AS place FROM l WHERE weight * remaining <= cap * weights),
t AS (SELECT l.source, l.held, l.weight, l.u0, l.u1, l.u2, CASE WHEN l.place < f.place THEN l.cap ELSE l.weight * x.remaining / x.weights END AS target
  FROM l, f, l AS x WHERE x.place = f.place),
p AS (SELECT d.doc_id, d.size, t.*, floor(t.target)::BIGINT AS goal,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, CASE WHEN held = 0 THEN 0 ELSE goal // held END AS passes, CASE WHEN held = 0 THEN 0 ELSE greatest(0, least(goal % held - start, size)) END AS part FROM p)
SELECT doc_id, size, held AS source_size, target, (passes * size + part)::BIGINT AS taken,
  CASE WHEN passes * size + part > 0 THEN {position("start")} END AS first_position,
  CASE WHEN passes * size + part > 0 THEN {position("(passes - CASE WHEN part > 0 THEN 0 ELSE 1 END) * held + start")} END AS last_position
FROM g"""


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _op7_sql() -> str:
    def canonical(x: str) -> str:
        out = rf"regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13), 'abcdefghijklmnopqrstuvwxyz' || chr(10)), '(^|\n)[^a-z0-9\n\x{{80}}-\x{{10FFFF}}]*(copyright|©|\(c\))[^\n]*[0-9]{{4}}[^\n]*', '\1', 'g')"
        out = rf"regexp_replace({out}, '[^a-z0-9\n\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')"
        for spelled, usual in SPELLINGS:
            out = f"replace({out}, {_sql_text(spelled)}, {_sql_text(usual)})"
        return rf"list_transform(string_split(regexp_replace({out}, ' *\n *', chr(10), 'g'), chr(10)), lambda x: trim(x))"

    whole = "array_to_string(list_filter(lines, lambda x: x <> ''), ' ')"
    values = ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in known_texts())
    digests = ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in WHOLE_DIGESTS)
    return f"""
WITH listed AS (SELECT md5({whole}) AS digest, license_id FROM (SELECT license_id, {canonical("said")} AS lines FROM (VALUES {values}) AS v(license_id, said))
  UNION ALL SELECT * FROM (VALUES {digests}) AS v(digest, license_id)),
known AS (SELECT digest, min(license_id) AS license_id FROM listed GROUP BY 1),
d AS (SELECT doc_id, {canonical("coalesce(text, '')")} AS lines FROM documents),
u AS (SELECT doc_id, 0 AS line_no, {whole} AS unit FROM d
  UNION ALL SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS unit FROM d WHERE len(list_filter(lines, lambda x: x <> '')) > 1)
SELECT u.doc_id, CASE WHEN line_no = 0 THEN 'text' ELSE 'line' END AS scope, line_no::BIGINT AS line_no, license_id, digest
FROM u JOIN known ON md5(u.unit) = known.digest WHERE u.unit <> ''"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Windows at shared shingles, and their similarity; no fingerprints.
OP9_SQL = r"""
WITH lowered AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM lowered),
i AS (SELECT id AS item_id, words, len(words) AS n, least(len(words), 5) AS k FROM w WHERE kind = 'b' AND len(words) > 0),
ks AS (SELECT DISTINCT k FROM i),
ish AS (SELECT item_id, n, k, q, array_to_string(words[q + 1:q + k], ' ') AS sh FROM (SELECT *, unnest(range(0, n - k + 1)) AS q FROM i)),
dsh AS (SELECT id AS doc_id, k, p, array_to_string(words[p + 1:p + k], ' ') AS sh FROM (SELECT w.id, w.words, ks.k, unnest(range(0, len(w.words) - ks.k + 1)) AS p FROM w, ks WHERE w.kind = 'd')),
laid AS (SELECT DISTINCT d.doc_id, s.n, s.k, greatest(d.p - s.q, 0) AS start, s.n + least(d.p - s.q, 0) AS size FROM dsh d JOIN ish s ON d.sh = s.sh AND d.k = s.k),
win AS (SELECT l.doc_id, l.n, l.k, l.start, l.size, w.words[l.start + 1:l.start + l.size] AS words FROM laid l JOIN w ON w.kind = 'd' AND w.id = l.doc_id),
wsh AS (SELECT doc_id, n, k, start, size, sh, count(*) AS c FROM (SELECT *, array_to_string(words[g + 1:g + k], ' ') AS sh FROM (SELECT *, unnest(range(0, len(words) - k + 1)) AS g FROM win)) GROUP BY ALL),
ic AS (SELECT item_id, n, k, sh, count(*) AS c FROM ish GROUP BY ALL),
common AS (SELECT a.doc_id, a.start, a.size, a.n, a.k, b.item_id, sum(least(a.c, b.c)) AS common FROM wsh a JOIN ic b ON a.n = b.n AND a.k = b.k AND a.sh = b.sh GROUP BY ALL),
scored AS (SELECT c.*, greatest(len(win.words) - c.k + 1, 0) + c.n - c.k + 1 - c.common AS u, len(win.words) AS n_words FROM common c JOIN win ON c.doc_id = win.doc_id AND c.start = win.start AND c.size = win.size AND c.n = win.n AND c.k = win.k),
good AS (SELECT *, common::DOUBLE / u AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common::DOUBLE / u DESC, start, n_words) AS place FROM scored WHERE common * 100 >= u * 80)
SELECT doc_id, item_id, similarity, start::BIGINT AS start, n_words::BIGINT AS n_words FROM good WHERE place = 1"""

def op4_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = section_tokens(table(spark, sf_dir, "documents"), rule="first")
    return out.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    return identify(docs, train(docs), keep=("doc_id", "held_out"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), RULES)


OP6_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS tail FROM pages),
p AS (SELECT page_id, row_number() OVER () AS row_no, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT p.*, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY row_no ORDER BY length(r.host || r.path) DESC) AS place
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE place = 1"""


def op8_onebit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP8_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda x: (x[2] - x[1]) * (x[2] - x[1])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10"""


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archive(write_archive(table(spark, sf_dir, "pages"), archive_folder(spark)))

    def number(name: str):  # noqa: ANN202
        return F.expr(f"try_cast(substring({name}, 10) AS bigint)")

    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
s AS (SELECT *, strlen(html)::BIGINT AS n, min(page_id) OVER (PARTITION BY digest) AS least FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> least THEN least END AS refers_to FROM s"""



def op11_piece_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path  # only this query needs the vocabulary files

    model = path("piece_bpe_32k.model")
    coded = encode_texts(table(spark, sf_dir, "documents"), model).withColumn("n_tokens", F.size("ids").cast("long"))
    said = decode_ids(coded, model, keep=("doc_id", "n_tokens"), digest="ids_sha256")
    return said.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 by its table of 256, over the bytes of each different word.
OP12_SQL = r"""
WITH RECURSIVE bits AS (SELECT range AS b, range::UBIGINT AS c, 0 AS i FROM range(256)
  UNION ALL SELECT b, xor(c >> 1, (c & 1) * 3988292384), i + 1 FROM bits WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS steps FROM bits WHERE i = 8),
texts AS (SELECT true AS own, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
w AS (SELECT own, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
f AS (SELECT own, id, unnest(words) AS word FROM w),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM f)),
b AS (SELECT word, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::BIGINT + 1, 2))::UBIGINT)),
    lambda c, y: xor(c >> 8, steps[(xor(c, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000)::BIGINT AS bucket FROM h, crc),
n AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f JOIN b USING (word) GROUP BY bucket),
z AS (SELECT sum(s)::DOUBLE + 10000 AS ss, sum(t)::DOUBLE + 10000 AS tt FROM n),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ss / ((s + 1)::DOUBLE * tt)))::BIGINT AS gain FROM n, z),
sums AS (SELECT id, sum(gain)::BIGINT AS weight FROM f JOIN b USING (word) JOIN g USING (bucket) WHERE own GROUP BY id),
scored AS (SELECT w.id AS doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || w.id::VARCHAR), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN sums ON w.id = sums.id WHERE own),
e AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS held FROM scored WHERE n_features >= 20)
SELECT scored.*, CASE WHEN place <= 10 * held // 100 THEN place END AS rank FROM scored LEFT JOIN e USING (doc_id)"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_forest,
        op2_chat_formatting,
        op3_curriculum_mix,
        op4_token_attribution,
        op5_language_id,
        op6_url_filter,
        op7_license_scan,
        op8_onebit_neighbours,
        op9_decontamination,
        op10_warc_bundles,
        op11_piece_merges,
        op12_importance_resampling,
    )
}
SQL: dict[str, str] = {
    "op1_minhash_forest": OP1_SQL,
    "op2_chat_formatting": OP2_SQL,
    "op3_curriculum_mix": _op3_sql(),
    "op6_url_filter": OP6_SQL,
    "op7_license_scan": _op7_sql(),
    "op8_onebit_neighbours": OP8_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_warc_bundles": OP10_SQL,
    "op12_importance_resampling": OP12_SQL,
}
