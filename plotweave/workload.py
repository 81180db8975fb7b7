"""Registered queries over the test tables, each with the SQL it must agree with.

Every query reads whole tables and whole texts. The stand-in catalogue takes each document as
one film: its first three words are the title, the whole text is the plot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave import settings as S
from plotweave.functions import scores as P
from plotweave.functions import text as X
from plotweave.operators import lexical, merge, prepare
from plotweave.operators import vector_search as V
from plotweave.operators.embed import embed, hashed_words
from plotweave.plans import search as search_plan
from plotweave.plans.build import build_catalogue, entity_texts, stage_source
from plotweave.plans.present import page_counts, paged, result_cards
from plotweave.plans.similar import neighbours, present_similar, similar
from plotweave.scratch import scratch_path, spread, stage
from plotweave.sources.catalogue import open_catalogue
from plotweave.sources.specs import SourceSpec, film_sources, read_csv

EMBEDDER = hashed_words()
VECTOR_DIM = 64
NEIGHBOURS = 10

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text table, read by all cores however few row groups it has."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


# --- Inputs ----------------------------------------------------------------------------------


def films(spark: SparkSession, sf_dir: str, all_words: bool = False) -> DataFrame:
    """Documents in canonical shape; with ``all_words`` every word of the text is a keyword."""
    docs = documents(spark, sf_dir)
    bare = X.strip(F.col("text"))
    title = X.first_words(bare, 3)
    return docs.select(
        title.alias("title"),
        (F.length(X.normalize_title(title)) % 70 + 1950).cast("string").alias("release_year"),
        F.concat_ws("|", "lang", "source").alias("genre"),
        F.col("text").alias("plot"),
        F.concat_ws(", ", "source", F.upper("source"), "lang").alias("cast"),
        F.col("source").alias("director"),
        (F.regexp_replace(bare, X.SPACE_RUN, ", ") if all_words else F.concat_ws(", ", "lang", "source")).alias(
            "keywords"),
        "source",
        F.lit(0).alias("src_rank"),
        F.col("doc_id").alias("src_ord"),
        F.lit(0).alias("recency"),
    )


def film_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an entity of its own, with searchable text."""
    return entity_texts(films(spark, sf_dir).withColumn("id", F.col("src_ord")))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries; bounds and genre pattern follow from the text length."""
    n = F.length("text")
    shift = n % 40
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        X.parse_year_bound(
            F.when(n % 2 == 0, F.concat(F.lit(" "), (shift + 1950).cast("string")))
            .otherwise("n/a")).alias("min_year"),
        X.parse_year_bound(
            F.when(n % 5 == 0, F.lit("")).otherwise((shift + 1975).cast("string"))
        ).alias("max_year"),
        F.when(n % 3 == 0, "e[ns]").when(n % 3 == 1, "FR|DE").otherwise("").alias("genre"),
    )


def item_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors as entities."""
    return spread(table(spark, sf_dir, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("item "), F.col("vec_id").cast("string")).alias("title"),
        (F.col("label") + 2000).cast("string").alias("release_year"),
        F.lit(S.UNKNOWN).alias("genre"), F.lit("").alias("plot"),
        F.col("embedding").alias("vector"),
    )


def vector_queries(items: DataFrame) -> DataFrame:
    return items.select(F.col("id").alias("query_id"), "vector")


# --- SQL building blocks ---------------------------------------------------------------------

# White space as the text functions see it, for an engine whose \s is ASCII only.
_WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}" \
      r"\x{202f}\x{205f}\x{3000}"
_TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
_DIM = EMBEDDER.dim


def q_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def q_title(x: str) -> str:
    lowered = q_strip(f"lower(coalesce({x}, 'nan'))")
    bare = f"regexp_replace({lowered}, '[^\\p{{L}}\\p{{N}}_{_WS}]', ' ', 'g')"
    no_article = f"regexp_replace({bare}, '^(the|a|an)[{_WS}]+', '')"
    return q_strip(f"regexp_replace({no_article}, '[{_WS}]+', ' ', 'g')")


def q_year(x: str) -> str:
    found = f"regexp_extract({x}, '([0-9]{{4}})', 1)"
    return (f"case when try_cast({found} as int) between 1880 and 2030 then {found} "
            "else 'Unknown' end")


def q_tokens(x: str) -> str:
    split = f"regexp_split_to_array(lower({x}), '{_TOKEN_SPLIT}')"
    return f"list_filter({split}, lambda t: t <> '')"


def q_title_case(x: str) -> str:
    """Character by character: a letter with case behind one without (or at the start) is raised.

    Stated apart from the expression it is compared with, which works on runs of a pattern.
    """
    here, before = f"substr({x}, i, 1)", f"substr({x}, i - 1, 1)"
    return (f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: case "
            f"when i > 1 and lower({before}) <> upper({before}) then lower({here}) "
            f"when {here} = 'ß' then 'Ss' else upper({here}) end), '')")


def q_percent(x: str) -> str:
    return f"round_even({x} * 100, 1)::varchar || '%'"


_FILM_WORDS = f"regexp_split_to_array({q_strip('text')}, '[{_WS}]+')"


def q_films(keywords: str) -> str:
    return f"""
films as (
  select *, (1950 + length({q_title('title')}) % 70)::varchar release_year from (
    select doc_id, array_to_string(w[1:3], ' ') title, lang || '|' || source genre, text plot,
           source || ', ' || upper(source) || ', ' || lang "cast", source director,
           {keywords} keywords, source, lang
    from (select *, {_FILM_WORDS} w from documents)))"""


Q_FILMS = q_films("concat_ws(', ', lang, source)")
Q_FILMS_ALL_WORDS = q_films("array_to_string(w, ', ')")


def q_combined(plot: str = "plot") -> str:
    return f"""concat_ws('. ', 'Title: ' || title, 'Release Year: ' || release_year,
    'Genre: ' || genre, case when "cast" <> '' then 'Cast: ' || "cast" end,
    case when director not in ('', 'Unknown') then 'Director: ' || director end,
    case when keywords <> '' then 'Keywords: ' || keywords end,
    'Plot: ' || substring({plot}, 1, 1500))"""


Q_ENTITIES = Q_FILMS + f""",
entities as (select doc_id id, title, release_year, genre, plot, {q_combined()} combined_text
             from films)"""

Q_BATCH = """
batch as (
  select item_id query_id, text query,
         case when length(text) % 2 = 0 then 1950 + length(text) % 40 end min_year,
         case when length(text) % 5 <> 0 then 1975 + length(text) % 40 end max_year,
         case length(text) % 3 when 0 then 'e[ns]' when 1 then 'FR|DE' else '' end q_genre
  from benchmark)"""


def q_vectors(name: str, source: str, key: str, text: str) -> str:
    """CTEs giving (key, v double[]) of the default embedder."""
    return f"""
{name}_b as (
  select {key}, b, count(*) c from (
    select {key}, ('0x' || substr(md5(t), 1, 8))::bigint % {_DIM} b
    from (select {key}, unnest({q_tokens(text)}) t from {source}))
  group by all),
{name}_n as (select {key}, sqrt(sum(c * c)) n from {name}_b group by all),
{name} as (
  select k.{key}, list(coalesce((b.c / n.n)::float, 0::float)::double order by r.i) v
  from (select {key} from {source}) k cross join range({_DIM}) r(i)
  left join {name}_b b on b.{key} = k.{key} and b.b = r.i
  left join {name}_n n on n.{key} = k.{key}
  group by k.{key})"""


def q_bm25(limit: int) -> str:
    """CTEs from ``entities`` and ``batch`` to ``text_hits(query_id, id, score, rank)``."""
    return f"""
toks as (select id, unnest({q_tokens('combined_text')}) term from entities),
lens as (select id, len({q_tokens('combined_text')}) n from entities),
post as (select term, id, count(*) tf from toks group by all),
dfs as (select term, count(*) df from post group by all),
corpus as (select count(*) docs, avg(n) avg_len from lens),
asked as (select distinct query_id, unnest({q_tokens('query')}) term from batch),
bm as (
  select query_id, id, round(sum(ln(1 + (docs - df + 0.5::double) / (df + 0.5::double))
    * (tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * n / avg_len))), 6)
    score
  from asked join post using (term) join dfs using (term) join lens using (id), corpus
  group by all),
text_hits as (select * from (
  select *, row_number() over (partition by query_id order by score desc, id) rank from bm)
  where rank <= {limit})"""


def q_hybrid(limit: int = S.RETRIEVAL_LIMIT) -> str:
    """CTEs from ``entities`` and ``batch`` to ``cand``: both arms, first per text."""
    return (
        q_vectors("ev", "entities", "id", "combined_text") + ","
        + q_vectors("qv", "batch", "query_id", "query") + f""",
vec_hits as (select * from (
  select *, row_number() over (partition by query_id order by score desc, id) rank from (
    select query_id, id, round(list_inner_product(qv.v, ev.v), 6) score from qv, ev))
  where rank <= {limit}),""" + q_bm25(limit) + """,
arms as (select query_id, id, 0 arm, rank from vec_hits
         union all select query_id, id, 1, rank from text_hits),
cand as (select * exclude (n) from (
  select *, row_number() over (partition by query_id, combined_text order by arm, rank) n
  from arms join entities using (id)) where n = 1)""")


Q_FILTERED = """
kept as (
  select c.*, query from cand c join batch using (query_id)
  where (min_year is null or try_cast(release_year as double) >= min_year)
    and (max_year is null or try_cast(release_year as double) <= max_year)
    and (q_genre = '' or regexp_matches(genre, '(?i)' || q_genre)))"""

Q_RANKED = f"""
pairs as (
  select *, list_distinct({q_tokens('query')}) q,
         list_distinct({q_tokens(f'substring(combined_text, 1, {S.RERANK_CHARS})')}) p from kept),
overlap as (select *, len(list_intersect(q, p))::double s from pairs),
ranked as (
  select *, round(1 / (1 + exp(-(6 * s / greatest(len(q), 1)
         + 6 * s / greatest(len(q) + len(p) - s, 1) - 4))), 6) confidence from overlap)"""


def q_results(n: int) -> str:
    return f"""
best as (select * from (
  select *, row_number() over (partition by query_id order by confidence desc, id) result_rank
  from ranked) where result_rank <= {n}),
results as (
  select query_id, result_rank, id, title "Title", release_year "Release Year", genre "Genre",
         plot "Plot", {q_percent('confidence')} "Confidence", confidence confidence_score
  from best)"""


def q_search(n: int) -> str:
    return ", ".join([Q_ENTITIES, Q_BATCH, q_hybrid(), Q_FILTERED, Q_RANKED, q_results(n)])


# --- Preparation -----------------------------------------------------------------------------

_SHAPE_A = SourceSpec(
    name="alpha", path="", title="Title", year="Release Year", genre="Genre", plot="Plot",
    cast="Cast", director="Director", order="doc_id")
_SHAPE_B = SourceSpec(
    name="beta", path="", title="movie_title", year="yr", genre="genre", plot="synopsis",
    keywords=("kw_a", "kw_b", "kw_missing"), order="doc_id")


def two_shapes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The documents as two sources with different column names, split by language."""
    rows = films(spark, sf_dir, all_words=True).withColumn("lang", F.split("genre", r"\|")[0])
    a = rows.filter(F.col("lang").isin("en", "de")).select(
        F.col("title").alias("Title"), F.col("release_year").alias("Release Year"),
        F.col("genre").alias("Genre"), F.col("plot").alias("Plot"), F.col("cast").alias("Cast"),
        F.col("director").alias("Director"), F.col("src_ord").alias("doc_id"))
    b = rows.filter(~F.col("lang").isin("en", "de")).select(
        F.col("title").alias("movie_title"), "genre", F.col("plot").alias("synopsis"),
        F.col("keywords").alias("kw_a"),
        F.when(F.col("source") != "src0", F.col("source")).alias("kw_b"),
        F.col("src_ord").alias("doc_id"))
    return {"alpha": a, "beta": b}


_Q_TWO_SHAPES = Q_FILMS_ALL_WORDS + """,
shaped as (
  select 'alpha' source, 0 src_rank, doc_id src_ord, title, release_year, genre, plot, "cast",
         director, '' keywords from films where lang in ('en', 'de')
  union all
  select 'beta', 1, doc_id, title, 'Unknown', genre, plot, '', '',
         concat_ws(', ', keywords, case when source <> 'src0' then source end)
  from films where lang not in ('en', 'de'))"""


@register("canonicalise_sources", f"""
with {_Q_TWO_SHAPES} select * from shaped""")
def canonicalise_sources(spark, sf_dir):
    shapes = two_shapes(spark, sf_dir)
    frames = [
        prepare.canonicalise(shapes[spec.name], spec, rank)
        for rank, spec in enumerate([_SHAPE_A, _SHAPE_B])
    ]
    return prepare.union_sources(frames).drop("recency")


@register("quality_gate", f"""
select doc_id, length({q_strip('text')}) plot_chars from documents
where length({q_strip('text')}) >= 30""")
def quality_gate(spark, sf_dir):
    return prepare.quality_gate(films(spark, sf_dir)).select(
        F.col("src_ord").alias("doc_id"), prepare.plot_length().alias("plot_chars"))


@register("gate_report", f"""
select source, count(*) filter (where length({q_strip('text')}) >= 30) kept,
       count(*) filter (where length({q_strip('text')}) < 30) dropped
from documents group by source""")
def gate_report(spark, sf_dir):
    return prepare.gate_report(films(spark, sf_dir))


@register("newest_n", f"""
select o_orderkey, year from (
  select o_orderkey, strftime(o_orderdate, '%Y') as "year" from orders)
order by "year"::int desc, o_orderkey limit {S.NEWEST_TEST_PROFILE}""")
def newest_n(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("src_ord"),
        F.date_format("o_orderdate", "yyyy").alias("release_year"))
    return prepare.newest_n(orders, S.NEWEST_TEST_PROFILE).select(
        F.col("src_ord").alias("o_orderkey"), F.col("release_year").alias("year"))


@register("normalise_year", f"""
select doc_id, {q_year('text')} release_year,
       coalesce(try_cast(regexp_extract(text, '([0-9]{{4}})', 1) as int), 0) recency_key
from documents""")
def normalise_year(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", X.normalize_year(F.col("text")).alias("release_year"),
        X.recency_key(F.col("text")).alias("recency_key"))


_PAGE_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@register("normalise_title", f"""
select page_id, {q_title(_PAGE_TITLE)} title_key from pages""")
def normalise_title(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", X.normalize_title(title).alias("title_key"))


_MIXED = "\u65e5\u672cabc \ud55c\uad6dFILM o'neil"


@register("title_case", f"""
with titles as (select page_id, {_PAGE_TITLE} || ' {_MIXED.replace("'", "''")}' t from pages)
select page_id, {q_title_case('t')} shown from titles""")
def title_case(spark, sf_dir):
    title = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(f" {_MIXED}"))
    return table(spark, sf_dir, "pages").select("page_id", X.title_case(title).alias("shown"))


# --- Text files --------------------------------------------------------------------------------

_NA_LIST = ", ".join("'" + token + "'" for token in S.NA_TOKENS)


def _as_csv(df: DataFrame, path: str, **options) -> str:
    """``df`` as CSV files at ``path``, in the order of its first column."""
    df.orderBy(df.columns[0]).write.options(
        header="true", quote='"', escape='"', quoteAll="true", **options).csv(path)
    return path


def _texts_with_marks(spark, sf_dir) -> DataFrame:
    """Documents with doubled quotes, commas, line breaks and missing-value words."""
    kind = F.col("doc_id") % 7
    marked = (F.when(kind == 0, F.concat(F.lit('a "quoted", b\n'), F.col("text")))
              .when(kind == 1, "NA").when(kind == 2, "nan").when(kind == 3, "")
              .otherwise(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", marked.alias("body"), "source")


@register("csv_scan", f"""
with marked as (
  select doc_id, source, case doc_id % 7 when 0 then 'a "quoted", b' || chr(10) || text
    when 1 then 'NA' when 2 then 'nan' when 3 then '' else text end body from documents)
select doc_id::varchar doc_id, case when body not in ({_NA_LIST}) then body end body, source
from marked""")
def csv_scan(spark, sf_dir):
    """A CSV with every column as text; missing-value words come back as nulls."""
    path = _as_csv(_texts_with_marks(spark, sf_dir), scratch_path(spark, "documents-csv"),
                   nullValue="", emptyValue="")
    return read_csv(spark, SourceSpec(name="documents", path=path, title="doc_id"))


#: Newest rows of each source in the registered build; None takes all.
_LIMITS = {"wiki": 40, "imdb": None, "movieverse": None}

_Q_SOURCES = f"""
with {Q_FILMS},
split as (
  select *, case doc_id % 3 when 0 then 'wiki' when 1 then 'imdb' else 'movieverse' end src
  from films where length({q_strip('plot')}) >= {S.MIN_PLOT_CHARS}),
ranked as (
  select *, row_number() over (partition by src order by release_year::int desc, doc_id) n
  from split)
select src source, doc_id::varchar title, release_year from ranked
where src <> 'wiki' or n <= {_LIMITS['wiki']}"""


@register("source_profile", _Q_SOURCES)
def source_profile(spark, sf_dir):
    """The three sources of the full profile from their files, one cut to its newest rows and one
    freed of its limit."""
    rows = films(spark, sf_dir)
    folder = scratch_path(spark, "film-files")
    for i, spec in enumerate(film_sources(folder, limit_newest=_LIMITS)):
        own = rows.filter(F.col("src_ord") % 3 == i).select(
            F.col("src_ord").alias(spec.title), F.col("release_year").alias(spec.year),
            F.col("plot").alias(spec.plot), F.col("genre").alias(spec.genre))
        _as_csv(own, spec.path)
    staged = [stage_source(spark, spec, i, S.MIN_PLOT_CHARS)[0]
              for i, spec in enumerate(film_sources(folder, limit_newest=_LIMITS))]
    return prepare.union_sources(staged).select("source", "title", "release_year")


def _guarded_batch(spark, sf_dir) -> DataFrame:
    """Passages of pages as queries: blank ones, bounds past any year, and plain ones."""
    kind = F.col("page_id") % 5
    digits = (F.when(kind == 1, "99999999999").when(kind == 2, "9" * 25).when(kind == 3, " 1970 ")
              .otherwise("19x0"))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("query_id"),
        F.when(kind == 0, F.lit(" \n\t ")).otherwise(
            F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("query"),
        X.parse_year_bound(digits).alias("min_year"))


_Q_GUARDED = f"""
guarded as (
  select page_id query_id, {q_strip(_PAGE_TITLE)} query,
         case page_id % 5 when 1 then 99999999999 when 2 then 9223372036854775807 when 3 then 1970
         end::bigint min_year
  from pages where page_id % 5 <> 0 and {q_strip(_PAGE_TITLE)} <> '')"""


@register("blank_queries", f"""
with {_Q_GUARDED} select query_id, query, min_year::varchar min_year from guarded""")
def blank_queries(spark, sf_dir):
    """Blank queries leave the batch, year bounds of any length stay numbers."""
    return search_plan.query_batch(_guarded_batch(spark, sf_dir)).select(
        "query_id", "query", F.col("min_year").cast("string").alias("min_year"))


@register("filter_guards", f"""
with {_Q_GUARDED}, {Q_FILMS},
marked as (
  select doc_id id, title, plot, "cast", director, keywords,
         case when doc_id % 4 = 0 then 'Unknown' else release_year end release_year,
         case when doc_id % 3 <> 0 then genre end genre from films),
entities as (select *, {q_combined()} combined_text from marked),
batch as (select query_id, query from guarded), {q_hybrid()}
select query_id, id, release_year, genre from cand join guarded using (query_id)
where min_year is null or try_cast(release_year as double) >= min_year""")
def filter_guards(spark, sf_dir):
    """Bounds against unknown years and null genres on all that is retrieved; where nothing fits,
    no row is left."""
    asked, rows = search_plan.pin(_guarded_batch(spark, sf_dir))
    marked = films(spark, sf_dir).withColumn("id", F.col("src_ord")).withColumns({
        "release_year": F.when(F.col("id") % 4 == 0, S.UNKNOWN).otherwise(F.col("release_year")),
        "genre": F.when(F.col("id") % 3 != 0, F.col("genre"))})
    entities = stage(embed(entity_texts(marked), "combined_text", EMBEDDER), "films")
    found = search_plan.retrieve(asked, entities, EMBEDDER, rows=rows)
    return search_plan.apply_filters(found, asked).select("query_id", "id", "release_year", "genre")


# --- Merging ---------------------------------------------------------------------------------

def _q_keyed(q_rows: str) -> str:
    return q_rows + f""",
keyed as (select *, {q_title('title')} title_key from films)"""


_Q_KEYED, _Q_KEYED_ALL_WORDS = _q_keyed(Q_FILMS), _q_keyed(Q_FILMS_ALL_WORDS)


@register("group_count", f"""
with {_Q_KEYED} select count(*) "groups" from (
  select distinct title_key, release_year from keyed)""")
def group_count(spark, sf_dir):
    return merge.group_count(merge.with_keys(films(spark, sf_dir)))


def _parts(spark, sf_dir) -> DataFrame:
    """Parts with lists of types and names; large parts have their names in capitals."""
    name = F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"), name.alias("title"),
        F.concat(F.col("p_type"), F.lit("|"), F.regexp_replace("p_name", " ", ","),
                 F.lit("/Back to top")).alias("genre"),
        F.concat(name, F.lit(", ['"), F.col("p_type"), F.lit("'], unknown")).alias("cast"),
        F.lit(0).alias("src_rank"), F.lit(0).alias("recency"),
        F.col("p_partkey").alias("src_ord"))


_Q_PARTS = """
parts as (
  select p_brand brand, p_partkey, name title,
         p_type || '|' || replace(p_name, ' ', ',') || '/Back to top' genre,
         name || ', [''' || p_type || '''], unknown' "cast"
  from (select *, case when p_size > 25 then upper(p_name) else p_name end as name from part))"""


@register("canonical_title", f"""
with {_Q_PARTS} select brand, title from (
  select *, row_number() over (partition by brand order by n desc, f) r from (
    select brand, title, count(*) n, min(p_partkey) f from parts group by all)) where r = 1""")
def canonical_title(spark, sf_dir):
    return merge.canonical_title(_parts(spark, sf_dir), ["brand"])


_Q_GENRE_NOISE = "('unknown', 'back to top', 'nan', 'none', '')"


def q_genres(source: str, keys: str) -> str:
    return f"""
genre_parts as (
  select {keys}, {q_strip('g')} g from (
    select {keys}, unnest(regexp_split_to_array(genre, '[,|\\[\\]/]')) g from {source})),
genres as (
  select {keys}, coalesce(string_agg(g, ', ' order by g), 'Unknown') genre from (
    select distinct {keys}, {q_title_case('g')} g from genre_parts
    where lower(g) not in {_Q_GENRE_NOISE}) group by all)"""


@register("combine_genres", f"""
with {_Q_PARTS}, {q_genres('parts', 'brand')} select brand, genre from genres""")
def combine_genres(spark, sf_dir):
    return merge.combine_genres(_parts(spark, sf_dir), ["brand"]).drop("id")


def q_terms(name: str, source: str, keys: str, column: str, order: str) -> str:
    term = q_strip("regexp_replace(part, '[\\[\\]''\"]', '', 'g')")
    return f"""
{name} as (
  select {keys}, string_agg(term, ', ' order by o, pos) terms from (
    select *, row_number() over (partition by {keys} order by o, pos) n from (
      select *, row_number() over (partition by {keys}, lower(term) order by o, pos) r from (
        select {keys}, o, pos, {term} term from (
          select {keys}, {order} o, unnest(p) part, generate_subscripts(p, 1) pos
          from (select *, string_split({column}, ',') p from {source})))
      where lower(term) not in ('', 'unknown', 'nan'))
    where r = 1)
  where n <= {S.MAX_TERMS} group by {keys})"""


@register("combine_terms", f"""
with {_Q_PARTS}, {q_terms('t', 'parts', 'brand', '"cast"', 'p_partkey')}
select brand, terms "cast" from t""")
def combine_terms(spark, sf_dir):
    return merge.combine_terms(_parts(spark, sf_dir), ["cast"], ["brand"])


def _keyed(spark, sf_dir, all_words: bool = False) -> DataFrame:
    """Canonical rows staged as the build does it, so every branch reads only its columns."""
    return stage(merge.with_keys(films(spark, sf_dir, all_words)), "films")


_Q_MERGED_PLOTS = q_vectors("pv", "documents", "doc_id", "text") + f""",
o as (
  select title_key || '#' || release_year k, title_key, release_year, doc_id, plot,
         {q_strip('plot')} stripped, v,
         row_number() over (partition by title_key, release_year
                            order by length({q_strip('plot')}) desc, doc_id) i
  from keyed join pv using (doc_id) where {q_strip('plot')} <> ''),
near as (
  select a.k, a.i i1, b.i i2 from o a join o b on a.k = b.k and a.i < b.i
  where a.plot = b.plot
     or round(list_inner_product(a.v, b.v), 6) >= {S.DUPLICATE_THRESHOLD}::double),
walk as (
  select k, 1::bigint i, [1::bigint] kept from o where i = 1
  union all
  select o.k, o.i,
         case when exists (select 1 from near n where n.k = walk.k and n.i2 = o.i
                           and list_contains(walk.kept, n.i1))
              then walk.kept else list_append(walk.kept, o.i) end
  from walk join o on o.k = walk.k and o.i = walk.i + 1),
chosen as (select k, arg_max(kept, i) kept from walk group by k),
plots as (
  select title_key, release_year, string_agg(stripped, chr(10) || chr(10) order by i) plot
  from o join chosen using (k) where list_contains(kept, i) group by all)"""


@register("merge_plots", f"""
with recursive {_Q_KEYED}, {_Q_MERGED_PLOTS} select title_key, release_year, plot from plots""")
def merge_plots(spark, sf_dir):
    return merge.merge_plots(_keyed(spark, sf_dir), EMBEDDER)


@register("merge_plots_large_groups", ORACLES["merge_plots"])
def merge_plots_large_groups(spark, sf_dir):
    """The same result by the plan for groups too large to gather."""
    rows = _keyed(spark, sf_dir)
    return merge.merge_plots(rows, EMBEDDER, max_group=16, head_rows=32, rows_per_task=64)


_GROUP = "title_key, release_year"


def _q_merged(source: str) -> str:
    return ", ".join([
        _Q_MERGED_PLOTS,
        q_genres(source, _GROUP),
        *[q_terms(f"t_{c}", source, _GROUP, f'"{c}"', "doc_id")
          for c in ("cast", "director", "keywords")],
        f"""
titles as (select * from (
  select *, row_number() over (partition by {_GROUP} order by n desc, f) r,
         min(f) over (partition by {_GROUP}) id from (
    select {_GROUP}, title, count(*) n, min(doc_id) f from {source} group by all)) where r = 1),
merged as (
  select id, {_GROUP}, title, coalesce(g.genre, 'Unknown') genre, coalesce(p.plot, '') plot,
         coalesce(c.terms, '') "cast", coalesce(d.terms, '') director,
         coalesce(w.terms, '') keywords
  from titles left join genres g using ({_GROUP}) left join plots p using ({_GROUP})
  left join t_cast c using ({_GROUP}) left join t_director d using ({_GROUP})
  left join t_keywords w using ({_GROUP}))"""])


@register("merge_entities", f"""
with recursive {_Q_KEYED_ALL_WORDS}, {_q_merged('keyed')} select * from merged""")
def merge_entities(spark, sf_dir):
    return merge.merge_entities(_keyed(spark, sf_dir, all_words=True), EMBEDDER)


@register("combined_text", f"""
with {Q_ENTITIES} select id, combined_text from entities""")
def combined_text(spark, sf_dir):
    return film_entities(spark, sf_dir).select("id", "combined_text")


# --- Vectors ---------------------------------------------------------------------------------


@register("embed_text", f"""
with {q_vectors('v', 'documents', 'doc_id', 'text')}
select doc_id, bucket::int bucket, round(value, 6) as "value" from (
  select doc_id, generate_subscripts(v, 1) - 1 bucket, unnest(v) as "value" from v)
where "value" <> 0""")
def embed_text(spark, sf_dir):
    vectors = embed(documents(spark, sf_dir).select("doc_id", "text"), "text", EMBEDDER)
    return vectors.select("doc_id", F.posexplode("vector").alias("bucket", "value")).filter(
        F.col("value") != 0).withColumn("value", P.quantise(F.col("value")))


_Q_KNN = f"""
select query_id, id, score, rank from (
  select *, row_number() over (partition by query_id order by score desc, id) rank from (
    select a.vec_id query_id, b.vec_id id,
           round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) score
    from embeddings a, embeddings b))
where rank <= {NEIGHBOURS}"""


@register("knn_exact", _Q_KNN)
def knn_exact(spark, sf_dir):
    items = item_entities(spark, sf_dir)
    return V.exact_knn(vector_queries(items), items, NEIGHBOURS, VECTOR_DIM)


@register("knn_exact_cells", _Q_KNN)
def knn_exact_cells(spark, sf_dir):
    """The same neighbours through cells whose bounds say which of them can hold one."""
    items, index = _cells(spark, sf_dir)
    return V.exact_knn_by_cells(vector_queries(items), index, NEIGHBOURS)


@register("knn_exact_blocks", _Q_KNN)
def knn_exact_blocks(spark, sf_dir):
    """The same neighbours by the plan for query batches above the broadcast bound."""
    items = item_entities(spark, sf_dir)
    return V.exact_knn(
        vector_queries(items), items, NEIGHBOURS, VECTOR_DIM, max_broadcast_bytes=0)


def _cells(spark, sf_dir, **options) -> tuple[DataFrame, V.CellIndex]:
    items = item_entities(spark, sf_dir)
    return items, V.build_cells(items, VECTOR_DIM, **options)


def _label_centres(spark, sf_dir) -> np.ndarray:
    """Mean vector of each label, at six places: centres and code entries that SQL can state."""
    means = table(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.array(*[F.round(F.avg(F.col("embedding")[i].cast("double")), 6)
                  for i in range(VECTOR_DIM)]).alias("m")).orderBy("label").collect()
    return np.array([r["m"] for r in means])


_Q_CENTRES = f"""
parts as (
  select vec_id, label, generate_subscripts(embedding, 1) i, unnest(embedding)::double x
  from embeddings),
means as (select label, i, round(avg(x), 6) m from parts group by all),
centres as (
  select row_number() over (order by label) - 1 cell, list(m order by i) m
  from means group by label)"""

_Q_IVF = f"""
with {_Q_CENTRES},
near as (
  select vec_id, cell, embedding::double[] v,
         row_number() over (partition by vec_id order by
           list_inner_product(m, embedding::double[]) desc, cell) own,
         row_number() over (partition by vec_id order by
           round(list_inner_product(m, embedding::double[]), 6) desc, cell) place
  from embeddings, centres),
hits as (
  select q.vec_id query_id, c.vec_id id, round(list_inner_product(q.v, c.v), 6) score
  from near q join near c on q.cell = c.cell and q.place <= {{probes}} and c.own = 1)
select query_id, id, score, rank from (
  select *, row_number() over (partition by query_id order by score desc, id) rank from hits)
where rank <= {NEIGHBOURS}"""


@register("ivf_search", _Q_IVF.format(probes=4))
def ivf_search(spark, sf_dir):
    """Cells around given centres, of which each query reads four."""
    centres = _label_centres(spark, sf_dir)
    items, index = _cells(spark, sf_dir, centres=centres)
    return V.ann_search(vector_queries(items), index, NEIGHBOURS, probes=4)


@register("ivf_search_all_cells", _Q_KNN)
def ivf_search_all_cells(spark, sf_dir):
    """Probing every one of the fitted cells must give the exact neighbours."""
    items, index = _cells(spark, sf_dir)
    everything = V.cell_count(items.count())
    return V.ann_search(vector_queries(items), index, NEIGHBOURS, probes=everything)


_SUBS, _WIDTH, _REFINE = 16, VECTOR_DIM // 16, 10


@register("pq_search", f"""
with {_Q_CENTRES},
slices as (
  select vec_id, s, embedding[s * {_WIDTH} + 1:(s + 1) * {_WIDTH}]::double[] x
  from embeddings, range({_SUBS}) t(s)),
books as (select cell code, s, m[s * {_WIDTH} + 1:(s + 1) * {_WIDTH}] e from centres, range({_SUBS}) t(s)),
coded as (
  select vec_id, s, arg_min(e, (list_inner_product(e, e) - 2 * list_inner_product(x, e), code)) e
  from slices join books using (s) group by all),
decoded as (select vec_id, flatten(list(e order by s)) v from coded group by vec_id),
rough as (
  select q.vec_id query_id, d.vec_id id, round(list_inner_product(q.embedding::double[], d.v), 6) r
  from embeddings q, decoded d),
short as (select * from (
  select *, row_number() over (partition by query_id order by r desc, id) n from rough)
  where n <= {NEIGHBOURS * _REFINE}),
exact as (
  select query_id, id, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) score
  from short join embeddings a on a.vec_id = query_id join embeddings b on b.vec_id = id)
select query_id, id, score, rank from (
  select *, row_number() over (partition by query_id order by score desc, id) rank from exact)
where rank <= {NEIGHBOURS}""")
def pq_search(spark, sf_dir):
    """Search on codes of given books in all cells; the short list is scored again exactly."""
    centres = _label_centres(spark, sf_dir)
    books = np.ascontiguousarray(centres.reshape(-1, _SUBS, _WIDTH).transpose(1, 0, 2))
    items, index = _cells(spark, sf_dir, centres=centres, codebooks=books)
    return V.ann_search(vector_queries(items), index, NEIGHBOURS, probes=len(centres),
                        refine=_REFINE, use_codes=True)


@register("pq_search_fitted", _Q_KNN)
def pq_search_fitted(spark, sf_dir):
    """Fitted cells and books; a short list of every row must give the exact neighbours."""
    items, index = _cells(spark, sf_dir, sub_vectors=_SUBS)
    rows = items.count()
    return V.ann_search(vector_queries(items), index, NEIGHBOURS, probes=V.cell_count(rows),
                        refine=-(-rows // NEIGHBOURS), use_codes=True)


@register("similar_items", f"""
with pairs as (
  select a.vec_id query_id, b.vec_id id, b.label,
         round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) score
  from embeddings a, embeddings b where a.vec_id <> b.vec_id),
top as (select * from (
  select *, row_number() over (partition by query_id order by score desc, id) result_rank
  from pairs) where result_rank <= {S.SIMILAR_COUNT}),
sim as (select *, round(1 - least(greatest(1 - score, 0), 2), 6) similarity_score from top)
select query_id, result_rank, id, 'item ' || id as "Title", (2000 + label)::varchar "Release Year",
       'Unknown' "Genre", '' "Plot", {q_percent('similarity_score')} "Similarity",
       similarity_score
from sim""")
def similar_items(spark, sf_dir):
    items = item_entities(spark, sf_dir)
    anchors = items.select(F.col("id").alias("query_id"), "title", "release_year")
    return present_similar(neighbours(anchors, items, VECTOR_DIM))


# --- Full text -------------------------------------------------------------------------------

_Q_DOC_ENTITIES = "entities as (select doc_id id, text combined_text from documents)"


@register("postings", f"""
with toks as (select doc_id id, unnest({q_tokens('text')}) term from documents),
lens as (select doc_id id, len({q_tokens('text')}) doc_len from documents)
select term, id, doc_len::int doc_len, count(*) tf from toks join lens using (id) group by all""")
def postings(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return lexical.postings(docs, "text")


@register("bm25_topk", f"""
with {_Q_DOC_ENTITIES}, {Q_BATCH}, {q_bm25(S.RETRIEVAL_LIMIT)}
select query_id, id, score, rank from text_hits""")
def bm25_topk(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    queries, rows = search_plan.pin(batch(spark, sf_dir))
    return lexical.bm25_without_index(
        queries, docs, S.RETRIEVAL_LIMIT, "text", small_batch=rows is not None)


# --- Search ----------------------------------------------------------------------------------


def _candidates(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    queries, rows = search_plan.pin(batch(spark, sf_dir))
    entities = stage(embed(film_entities(spark, sf_dir), "combined_text", EMBEDDER), "films")
    return search_plan.retrieve(queries, entities, EMBEDDER, rows=rows), queries


@register("hybrid_retrieve", f"""
with {Q_ENTITIES}, {Q_BATCH}, {q_hybrid()} select query_id, id, arm, rank from cand""")
def hybrid_retrieve(spark, sf_dir):
    return _candidates(spark, sf_dir)[0].select("query_id", "id", "arm", "rank")


@register("filter_candidates", f"""
with {Q_ENTITIES}, {Q_BATCH}, {q_hybrid()}, {Q_FILTERED}
select query_id, id, release_year, genre from kept""")
def filter_candidates(spark, sf_dir):
    return search_plan.apply_filters(*_candidates(spark, sf_dir)).select(
        "query_id", "id", "release_year", "genre")


@register("rerank", f"""
with {Q_ENTITIES}, {Q_BATCH}, {q_hybrid()}, {Q_FILTERED}, {Q_RANKED}
select query_id, id, confidence from ranked""")
def rerank(spark, sf_dir):
    kept = search_plan.apply_filters(*_candidates(spark, sf_dir))
    return search_plan.rerank(kept).select("query_id", "id", "confidence")


def _results(spark, sf_dir, n: int) -> DataFrame:
    found, queries = _candidates(spark, sf_dir)
    return search_plan.finish(found, queries, n)


@register("search", f"with {q_search(S.NUM_RESULTS)} select * from results")
def search(spark, sf_dir):
    return _results(spark, sf_dir, S.NUM_RESULTS)


@register("result_cards", f"""
with {q_search(S.APP_RESULTS)}
select query_id, result_rank, id, "Title" title, "Release Year" as "year", "Plot" plot,
       "Genre" genre, "Confidence" confidence, replace("Confidence", '%', '')::double / 100 sim,
       "Title" || ' (' || "Release Year" || ')' "label",
       case when length("Plot") > 160 then substring("Plot", 1, 160) || '…' else "Plot" end preview,
       'Genre: ' || "Genre" || '  ·  Match: ' || "Confidence" meta,
       case when "Plot" <> '' then "Plot" else 'No plot available.' end body
from results""")
def cards(spark, sf_dir):
    return result_cards(_results(spark, sf_dir, S.APP_RESULTS))


@register("paged_results", f"""
with {q_search(S.APP_RESULTS)}
select query_id, id, result_rank, floor((result_rank - 1) / 6)::int page from results""")
def paged_results(spark, sf_dir):
    return paged(_results(spark, sf_dir, S.APP_RESULTS)).select(
        "query_id", "id", "result_rank", "page")


@register("entity_cards", f"""
with {Q_ENTITIES}, shown as (
  select id, title, release_year, plot, case when id % 3 = 0 then 'Unknown' else genre end genre
  from entities)
select id, title, release_year as "year", plot, genre, '' confidence, 0.0::double sim,
       title || ' (' || release_year || ')' "label",
       case when length(plot) > 160 then substring(plot, 1, 160) || '…' else plot end preview,
       case when genre in ('', 'Unknown') then 'Year: ' || release_year else 'Genre: ' || genre end
         meta,
       case when plot <> '' then plot else 'No plot available.' end body
from shown""")
def entity_cards(spark, sf_dir):
    """Cards of all entities as they are, without a score; without a genre they show the year."""
    genre = F.when(F.col("id") % 3 == 0, S.UNKNOWN).otherwise(F.col("genre"))
    return result_cards(film_entities(spark, sf_dir).select(
        "id", F.col("title").alias("Title"), F.col("release_year").alias("Release Year"),
        F.col("plot").alias("Plot"), genre.alias("Genre")))


@register("paged_by_ten", f"""
with {q_search(S.APP_RESULTS)}
select query_id, id, result_rank, floor((result_rank - 1) / 10)::int page from results
where result_rank <= 20""")
def paged_by_ten(spark, sf_dir):
    """Two pages of ten in place of the usual sizes."""
    return paged(_results(spark, sf_dir, S.APP_RESULTS), page_size=10, max_pages=2).select(
        "query_id", "id", "result_rank", "page")


@register("page_counts", f"""
with {q_search(S.APP_RESULTS)},
counted as (select query_id, count(*) n from results group by all)
select query_id, greatest(1, least(4, ceil(coalesce(n, 0) / 6)))::int pages
from batch left join counted using (query_id)""")
def pages_per_query(spark, sf_dir):
    return page_counts(batch(spark, sf_dir), _results(spark, sf_dir, S.APP_RESULTS))


# --- Stored catalogue ------------------------------------------------------------------------

_BUILT: dict[tuple[str, str, bool], str] = {}

_FILM_SOURCE = SourceSpec(
    name="films", path="", title="title", year="release_year", genre="genre", plot="plot",
    cast="cast", director="director", keywords=("keywords",), order="src_ord")


def catalogue_path(spark: SparkSession, sf_dir: str, all_words: bool = False) -> str:
    """Build the catalogue of a test folder once per application; without an index it fails."""
    key = (spark.sparkContext.applicationId, sf_dir, all_words)
    if key not in _BUILT:
        path = scratch_path(spark, "catalogue")
        build_catalogue(
            spark, [_FILM_SOURCE], path, EMBEDDER,
            tables={"films": films(spark, sf_dir, all_words)}, require_indexes=True)
        _BUILT[key] = path
    return _BUILT[key]


def _q_catalogue(q_keyed: str) -> str:
    return ", ".join([
        q_keyed,
        f"gated as (select * from keyed where length({q_strip('plot')}) >= 30)",
        _q_merged("gated").replace("from keyed join pv", "from gated join pv"),
        f"""
entities as (
  select id, title, release_year, genre, plot, "cast", director, keywords,
         {q_combined()} combined_text from merged)"""])


_Q_CATALOGUE = _q_catalogue(_Q_KEYED)


def _q_catalogue_search(q_keyed: str) -> str:
    return "with recursive " + ", ".join([
        _q_catalogue(q_keyed), Q_BATCH, q_hybrid(), Q_FILTERED, Q_RANKED,
        q_results(S.NUM_RESULTS)]) + " select * from results"


@register("build_catalogue", f"with recursive {_Q_CATALOGUE} select * from entities")
def build(spark, sf_dir):
    """Built anew on every call."""
    _BUILT.pop((spark.sparkContext.applicationId, sf_dir, False), None)
    path = catalogue_path(spark, sf_dir)
    return open_catalogue(spark, path, EMBEDDER).entities.drop("shard", "vector", "text_digest")


@register("catalogue_search", _q_catalogue_search(_Q_KEYED_ALL_WORDS))
def catalogue_search(spark, sf_dir):
    """On a catalogue whose keywords come from whole texts."""
    catalogue = open_catalogue(spark, catalogue_path(spark, sf_dir, all_words=True), EMBEDDER)
    return search_plan.search(batch(spark, sf_dir), catalogue, use_ann=False)


@register("catalogue_search_ann", _q_catalogue_search(_Q_KEYED))
def catalogue_search_ann(spark, sf_dir):
    """Through the vector index, reading all cells: the result of the flat scan."""
    catalogue = open_catalogue(spark, catalogue_path(spark, sf_dir), EMBEDDER)
    return search_plan.search(
        batch(spark, sf_dir), catalogue, probes=V.cell_count(catalogue.rows))


@register("catalogue_similar", f"""
with recursive {_Q_CATALOGUE}, {q_vectors('ev', 'entities', 'id', 'combined_text')},
pairs as (
  select a.id query_id, b.id id, round(list_inner_product(a.v, b.v), 6) score from ev a, ev b),
fetched as (select * from (
  select *, row_number() over (partition by query_id order by score desc, id) r from pairs)
  where r <= {S.SIMILAR_COUNT + 1}),
top as (select * from (
  select *, row_number() over (partition by query_id order by score desc, id) result_rank
  from fetched where query_id <> id) where result_rank <= {S.SIMILAR_COUNT})
select query_id, result_rank, id, round(1 - least(greatest(1 - score, 0), 2), 6) similarity_score,
       {q_percent('round(1 - least(greatest(1 - score, 0), 2), 6)')} "Similarity",
       title "Title", release_year "Release Year", genre "Genre", plot "Plot"
from top join entities using (id)""")
def catalogue_similar(spark, sf_dir):
    """Neighbours of every entity of the catalogue."""
    catalogue = open_catalogue(spark, catalogue_path(spark, sf_dir), EMBEDDER)
    anchors = catalogue.entities.select(F.col("id").alias("query_id"), "title", "release_year")
    return similar(anchors, catalogue, use_ann=False)
