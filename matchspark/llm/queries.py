"""The dealt operators as registered queries, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm import (
    bloom_lm,
    decontaminate,
    exact_dedup,
    language,
    licenses,
    packing,
    periodic_runs,
    quotes,
    simhash,
    spelling,
    substring_dedup,
    toxicity,
    wrappers,
)
from matchspark.llm.text import ascii_lower, held_out

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(function=None, *, sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register(function) if function else register


#: crc32 in SQL: the table of its bytes, and the fold over the bytes of ``x``, a text in hexadecimal.
CRC_TABLE = """tab as (
      select list(c order by i) as t from (
        select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
        from range(256) r(i)
      )
    )"""
CRC = """xor(4294967295, list_reduce(
        list_prepend(4294967295::bigint, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])
      ))"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    sql=f"""
    with d as (select doc_id, sha256({LOWER_SQL}) as text_sha256, {LOWER_SQL} as t from documents)
    select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
      doc_id = max(doc_id) over g as kept, text_sha256
    from d window g as (partition by t)
    """
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id of the row that stays for its text."""
    found = exact_dedup.mark(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest document that links reach."""
    found = simhash.near_components(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that some window of it repeats."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.matches(documents(spark, sf_dir), benchmark)
    return found.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.max("similarity").alias("similarity"), F.max_by("pos", F.struct("similarity", -F.col("pos"))).alias("start_word"),
        F.max_by("n_words", F.struct("similarity", -F.col("pos"))).alias("n_words"),
    )


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 2048 tokens."""
    return packed(documents(spark, sf_dir))


def packed(docs: DataFrame) -> DataFrame:
    found = packing.pack(docs)
    names = {"id": "doc_id", "crc": "ids_crc32", "total": "doc_tokens", "sequence": "sequence_id"}
    return found.withColumnsRenamed(names)


def language_model(docs: DataFrame) -> language.Model:
    """Fitted on the documents outside the held-out fold."""
    return language.fit(docs.filter(~held_out(F.col("doc_id"), 4, 2)))


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest language of every document."""
    docs = documents(spark, sf_dir)
    found = language.identify(docs, language_model(docs))
    named = found.select(F.col("id").alias("doc_id"), F.col("lang").alias("lang_pred"), "score", "rejected")
    return named.withColumn("held_out", held_out(F.col("doc_id"), 4, 2))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic every document is."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id"), 3, 1))
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).select(F.col("id").alias("doc_id"), "score")
    flags = {"held_out": held_out(F.col("doc_id"), 3, 1), "predicted": (F.col("score") >= 0.7).cast("int")}
    return found.withColumns(flags)


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What licence statements every document holds."""
    found = licenses.scan(documents(spark, sf_dir))
    named = F.array_sort(F.array_distinct(F.concat("base_labels", "detections.label")))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(named, ",").alias("labels"), "score",
        F.size("detections").alias("n_detections"),
    )


@query
def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely every document is, by exact token counts and by the filter's model."""
    docs = documents(spark, sf_dir)
    model = bloom_lm.fit(docs.filter(~held_out(F.col("doc_id"), 7, 2)))
    found = bloom_lm.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.withColumns({"held_out": held_out(F.col("doc_id"), 7, 2), "train_tokens": F.lit(model.tokens).cast("long")})


@query(
    sql="""
    with recursive m as (
      select distinct conv_id, turn, role, coalesce(text, '') as text from conversations
    ), one as (
      select conv_id, turn, min(text) as text from m group by all
    ), line as (
      select conv_id, turn, n, trim(regexp_replace(lower(said), '\\s+', ' ', 'g')) as said
      from (select conv_id, turn, unnest(string_split(text, chr(10))) as said, generate_subscripts(string_split(text, chr(10)), 1) as n from one)
    ), passage as (
      select distinct conv_id, turn, said, len(string_split(said, ' ')) as words
      from (
        select conv_id, turn, said from line where said <> ''
        union all
        select conv_id, turn, string_agg(said, ' ' order by n) from line where said <> '' group by conv_id, turn
      )
    ), origin as (
      select conv_id, said, min(turn) as source from passage group by all
    ), vote as (
      select p.conv_id, p.turn + back as turn, back, source, sum(words) as words
      from passage p join origin using (conv_id, said), (values (1), (2)) b(back)
      where source < p.turn + back group by all
    ), parent as (
      select conv_id, turn, arg_max(source, (-back, words, source)) as parent from vote group by all
    ), node as (
      select m.conv_id, turn, role, text, parent from m left join parent using (conv_id, turn)
    ), walk as (
      select conv_id, turn, turn as thread, 0::bigint as depth from node where parent is null
      union all
      select n.conv_id, n.turn, w.thread, w.depth + 1 from node n join walk w on n.conv_id = w.conv_id and n.parent = w.turn
    )
    select conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as body, parent, thread, depth,
      row_number() over (partition by conv_id, thread order by turn) - 1 as nth
    from node join walk using (conv_id, turn)
    """
)
def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of all conversations, rebuilt from messages that quote what they answer."""
    mail = quotes.as_mail(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = quotes.conversations(mail)
    return found.select(F.col("conv").alias("conv_id"), F.col("pos").alias("turn"), "role", "body", "parent", "thread", "depth", "nth")


@query
def op7_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = wrappers.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents, a tenth of which are given a stretch of one period up to their end.

    h is the crc32 of the id as text and g = floor(h / 10); where 10 divides h, the words from
    a = g % n on are replaced by repeats of the first p = 1 + floor((n - a) / (3 + g % 8)) of them.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    chosen = docs.filter(h % 10 == 0).select("doc_id", words.alias("words"), F.floor(h / 10).cast("long").alias("g"))
    n = F.size("words").cast("long")
    placed = chosen.withColumns({"n": n, "a": F.when(n > 0, F.col("g") % n).otherwise(0)})
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    rest = F.col("n") - F.col("a")
    period = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    times = F.ceil(rest / F.col("p")).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), rest.cast("int"))
    changed = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), repeated)
    text = F.when(F.col("n") > 0, F.array_join(changed, " ")).otherwise(F.lit(""))
    others = docs.filter((h % 10 != 0) | h.isNull()).select("doc_id", "text")
    return placed.select("doc_id", text.alias("text")).unionAll(others)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, and a digest of its words without their repeats."""
    found = periodic_runs.collapse(with_periods(documents(spark, sf_dir)))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select("id", "runs", "collapsed", longest.alias("best"), F.array_join(line, "").alias("lines"))
    best = F.col("best").getField
    start, period = -best("col2"), -best("col3")
    return rows.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"), best("length").alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.col3").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    sql="""
    with words as (
      select doc_id, row_number() over () as row, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
      from documents
    ), place as (
      select doc_id, row, w, unnest(range(1, len(w) - 11)) as i from words
    ), win as (
      select doc_id, row, i, array_to_string(w[i : i + 12], ' ') as said from place
    ), least as (
      select said, min(doc_id) as first from win group by said
    ), gone as (
      select distinct row, unnest(range(i, i + 13)) as i from win join least using (said) where first < doc_id
    ), away as (
      select row, list(i) as gone from gone group by row
    )
    select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
      sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(coalesce(gone, []), i)), ' ')) as kept_sha256
    from words left join away using (row)
    """
)
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that windows of earlier documents repeat."""
    found = substring_dedup.dedup(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Letters of a word, least letters and occurrences of a word, and of how many crc32s one is a slip.
LETTERS, LEAST_LETTERS, LEAST_TIMES, SLIPS = "[A-Za-zÀ-ÿ]+", 6, 5, 199


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters in lower case, of which one in ``SLIPS`` loses a letter, that are long and frequent enough."""
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(LETTERS), F.lit(0))
    long = docs.select("doc_id", F.explode(runs).alias("run")).filter(F.char_length("run") >= LEAST_LETTERS)
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run"))
    at = (h % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(h % SLIPS == 0, less).otherwise(F.col("run")).alias("word")
    return long.select(word).filter(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_TIMES)


@query(
    sql=f"""
    with recursive {CRC_TABLE}, runs as (
      select doc_id, run, count(*) as times
      from (select doc_id, unnest(regexp_extract_all({LOWER_SQL}, '[A-Za-zÀ-ÿ]+')) as run from documents)
      where length(run) >= 6 group by all
    ), bytes as (
      select run, times, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from runs
    ), hashed as (
      select run, times, {CRC} as h from bytes, tab
    ), slipped as (
      select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, times
      from hashed
    ), words as (
      select word, sum(times)::bigint as n from slipped where length(word) >= 6 group by word having sum(times) >= 5
    ), less as (
      select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(0, length(word))) as i from words)
    ), near as (
      select a.word, b.word as other, b.n as other_n from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
      union
      select less.word, words.word, words.n from less join words on rest = words.word
      union
      select words.word, less.word, less.n from less join words on rest = words.word
    ), best as (
      select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word
    ), forms as (
      select words.word, n, coalesce(n_near, 0) as n_near,
        case when other_n >= 5 * n then other end as form, case when other_n >= 5 * n then other_n end as form_n
      from words left join best using (word)
    ), path as (
      select word, word as spot, form as next from forms
      union all
      select path.word, forms.word, forms.form from path join forms on forms.word = path.next
    )
    select forms.word, n, n_near, forms.form, form_n, spot as root from forms join path on path.word = forms.word and path.next is null
    """
)
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with the spelling that it most likely stands for."""
    return spelling.variants(counted_words(documents(spark, sf_dir)))


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_PLACES = " union all ".join(
    f"select row, i, '{label}' as label from place where " + " and ".join(f"w{i} = '{w}'" for i, w in enumerate(p.split()))
    for p, label in PHRASES.items()
)


@query(
    sql=f"""
    with words as (
      select row_number() over () as row, doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
    ), token as (
      select row, unnest(w) as w0, generate_subscripts(w, 1) - 1 as i from words
    ), place as (
      select row, i, w0, lead(w0, 1) over o as w1, lead(w0, 2) over o as w2, lead(w0, 3) over o as w3 from token window o as (partition by row order by i)
    ), hit as ({_PLACES}), found as (
      select row, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from hit group by row
    )
    select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels
    from words left join found using (row)
    """
)
def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 finds of the four fixed phrases."""
    return op3_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


@query(
    sql=f"""
    with {CRC_TABLE}, rows as (
      select row_number() over () as row, doc_id, hex(encode(coalesce(doc_id::varchar, ''))) as x, list_append(list_filter(regexp_split_to_array({LOWER_SQL}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), '') as w
      from documents
    ), split as (
      select row, doc_id, w, coalesce({CRC} % 7 = 2, false) as held_out from rows, tab
    ), token as (
      select row, held_out, unnest(w) as word from split
    ), known as (
      select word, count(*) as c from token where not held_out group by word
    ), whole as (
      select sum(c)::bigint as n, count(*) as v from known
    ), scored as (
      select row, count(*) as n_tokens, count(c) as n_known, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) as base_score
      from token left join known using (word), whole group by row
    )
    select doc_id, held_out, n_tokens, n_known, n as train_tokens, round(base_score, 4) as base_score from split join scored using (row), whole
    """
)
def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of op4: tokens, known tokens and the base score."""
    found = op4_bloom_lm(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))
