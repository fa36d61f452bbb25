"""Queries of the operators in this subpackage over the given tables, by production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % folds


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors, by inner product, of every vector whose vec_id is divisible by 20."""
    from holdfast.llm import ann

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned from labels outside fold 2 of 4."""
    from holdfast.llm import quality

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(fold("doc_id", 4) != 2))
    scored = quality.classify(docs, model, out="score")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources by weights 5, 2, 1 takes from every document."""
    from holdfast.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op4_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.98 within labels."""
    from holdfast.llm import embdedup

    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learned from labels outside fold 1 of 3."""
    from holdfast.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, learn="crc32(cast(doc_id as string)) % 3 <> 1")
    scored = toxicity.classify(docs, model, out="score")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that start elsewhere too."""
    from holdfast.llm import suffixes

    return suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and the smallest doc_id of its near-duplicates."""
    from holdfast.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    from holdfast.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), telling=licenses.TELLING, texts=licenses.TEXTS)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces in sequences of at most 2048 tokens."""
    from holdfast.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of all conversations, linked, ordered, validated and serialised."""
    from holdfast.llm import chat

    return chat.link(*chat.calls_of_turns(table(spark, sf_dir, "conversations")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 highest-scoring documents of every benchmark item."""
    from holdfast.llm import search

    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of secrets in every document."""
    from holdfast.llm import secrets

    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent word that each is a variant of."""
    from holdfast.llm import variants

    return variants.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_neighbours, op2_quality, op3_mixing, op4_vector_copies, op5_toxicity, op6_suffixes, op7_simhash, op8_licenses, op9_packing, op10_tool_calls, op11_ranked_search, op12_secrets, op13_spelling, pipeline)}


_PAIRS = """pairs as materialized (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id
    where list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)) >= 0.98)"""

#: Equivalent SQL where there is some; the others hash, learn or tokenise, and tests hold them against brute force.
_SQL = {
    "op4_vector_copies": f"""with recursive {_PAIRS}, reach as (select vec_id, vec_id as other from embeddings union select r.vec_id, p.b from reach r join pairs p on p.a = r.other)
        select e.vec_id, (select count(*) from pairs p where p.a = e.vec_id) as n_links, min(r.other) as component_id, e.vec_id = min(r.other) as kept from embeddings e join reach r on r.vec_id = e.vec_id group by e.vec_id""",
    "op11_ranked_search": r"""with found as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
        held as materialized (select doc_id, term, count(*) as tf from found group by 1, 2), sizes as (select doc_id, sum(tf)::bigint as n from held group by 1),
        corpus as (select count(*) as docs, sum(n)::bigint as words from sizes), spread as (select term, count(*) as df from held group by 1),
        asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        scored as (select item_id, doc_id, sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::bigint as score
            from asked join held using (term) join spread using (term) join sizes using (doc_id), corpus group by 1, 2),
        ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0)
        select * from ranked where rank <= 50""",
    "op10_tool_calls": r"""with recursive turns as (select distinct conv_id, turn, role, text from conversations where conv_id is not null and turn is not null),
        numbered as (select *, row_number() over w - 1 as i, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words, length(text) % 5 = 0 as short, lag(turn) over w as t1, lag(turn, 2) over w as t2, lead(turn) over w as next, first_value(turn) over w as t0
            from turns where role = 'user' window w as (partition by conv_id order by turn, text)),
        made as (select conv_id, turn, i, case when words % 17 = 16 then 'browse' else ['search', 'count', 'rate'][words % 3 + 1] end as tool,
            case when words % 17 = 16 then 'unknown tool' when short and words % 3 = 0 then 'type of limit' when short and words % 3 = 1 then 'missing words' else '' end as problems,
            case words % 3 when 0 then '{"limit":' || case when short then '"many"' else words::varchar end || ',"query":' || to_json(text) || '}'
                when 1 then '{"text":' || to_json(text) || case when short then '' else ',"words":' || words end || '}'
                else '{"score":' || length(text) || '.5,"strict":' || case when short then 'true' else 'false' end || ',"text":' || to_json(text) || '}' end as arguments,
            case i % 4 when 0 then [next] when 1 then [t2] when 2 then [t1, t2] else [t1, t0] end as waits from numbered),
        edges as (select distinct conv_id, turn, unnest(waits) as dep from made),
        links as (select * from edges where dep is not null),
        reach as (select conv_id, turn, 0 as level from made where not exists (select 1 from links e where e.conv_id = made.conv_id and e.turn = made.turn)
            union select e.conv_id, e.turn, r.level + 1 from reach r join links e on e.conv_id = r.conv_id and e.dep = r.turn),
        levels as (select conv_id, turn, max(level) as level from reach group by 1, 2),
        calls as (select m.*, l.level, 'call-' || m.turn as call_id from made m join levels l on l.conv_id = m.conv_id and l.turn = m.turn),
        answered as (select a.conv_id, a.turn, a.text, case when a.turn % 13 = 12 then 'lost-' || a.turn else 'call-' || coalesce((select max(u.turn) from turns u where u.conv_id = a.conv_id and u.role = 'user' and u.turn < a.turn), a.turn - 1) end as call_id from turns a where a.role = 'assistant'),
        results as (select conv_id, call_id, min(turn) as turn, min_by(text, (turn, text)) as text from answered group by 1, 2)
        select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, coalesce(c.turn, r.turn) as position, c.level as level,
        case when c.turn is null then 'no call' when r.turn is null then 'no result' else 'linked' end as status, coalesce(c.problems = '', false) as valid, c.problems as problems,
        '{"arguments":' || coalesce(c.arguments, 'null') || ',"call_id":' || to_json(coalesce(c.call_id, r.call_id)) || ',"content":' || coalesce(to_json(r.text), 'null')
        || ',"level":' || coalesce(c.level::varchar, 'null') || ',"tool":' || coalesce(to_json(c.tool)::varchar, 'null') || '}' as message
        from calls c full join results r on r.conv_id = c.conv_id and r.call_id = c.call_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
