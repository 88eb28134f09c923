"""The question bank as a table: filters, pages, statistics, appends, evolution, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage
from .ordered import row_numbers
from .settle import first_of_keys

PAGE_LIMIT = 200
PART_ROWS = 1000


def matches(search: str, column: str = "question", literal: bool = True) -> Column:
    """Case-free search; ``literal=False`` lets ``%`` and ``_`` act as wildcards."""
    low = F.lower(column)
    return F.contains(low, F.lit(search.lower())) if literal else low.like(f"%{search.lower()}%")


def filter_bank(
    bank: DataFrame,
    exam_set: int | None = None,
    chapter: str | None = None,
    difficulty: str | None = None,
    bloom_level: str | None = None,
    search: str | None = None,
    literal: bool = True,
) -> DataFrame:
    """Rows that meet every given condition; a missing one does not filter."""
    for name, value in (
        ("exam_set", exam_set), ("chapter", chapter), ("difficulty", difficulty), ("bloom_level", bloom_level),
    ):
        if value is not None:
            bank = bank.where(F.col(name) == value)
    return bank.where(matches(search, literal=literal)) if search else bank


def page(bank: DataFrame, number: int, size: int = 50) -> DataFrame:
    """One page in set and id order, with the total on every row."""
    if number < 1 or not 1 <= size <= PAGE_LIMIT:
        raise ValueError(f"page starts at 1 and holds 1 to {PAGE_LIMIT} rows")
    total = bank.agg(F.count("*")).scalar()
    return bank.orderBy("exam_set", "id").offset((number - 1) * size).limit(size).withColumn("total", total)


def page_after(bank: DataFrame, exam_set: int, last_id: int, size: int = 50) -> DataFrame:
    """The page after a known row: deep pages cost no more than the first one."""
    later = (F.col("exam_set") > exam_set) | ((F.col("exam_set") == exam_set) & (F.col("id") > last_id))
    return bank.where(later).orderBy("exam_set", "id").limit(size)


def set_listing(bank: DataFrame) -> DataFrame:
    return bank.groupBy("exam_set").agg(
        F.count("*").alias("total_questions"), F.max("created_epoch").alias("generated_epoch")
    )


def statistics(bank: DataFrame) -> DataFrame:
    """Totals and counts per difficulty, Bloom level and chapter in one pass.

    Rows are first counted per (set, difficulty, Bloom level, chapter), so the
    grouping sets expand counts and not questions.
    """
    cells = bank.groupBy("exam_set", "difficulty", "bloom_level", "chapter").agg(F.count("*").alias("c"))
    dims = [F.col("difficulty"), F.col("bloom_level"), F.col("chapter")]
    grouped = cells.groupingSets([[dims[0]], [dims[1]], [dims[2]], []], *dims).agg(
        F.sum("c").alias("n"), F.countDistinct("exam_set").alias("sets"), F.grouping_id().alias("g")
    )
    kind = (
        F.when(F.col("g") == 3, "difficulty").when(F.col("g") == 5, "bloom_level")
        .when(F.col("g") == 6, "chapter").otherwise("total")
    )
    return grouped.select(
        kind.alias("kind"), F.coalesce("difficulty", "bloom_level", "chapter").alias("value"), "n", "sets"
    )


def landing_cards(bank: DataFrame) -> DataFrame:
    cells = bank.groupBy("exam_set", "difficulty", "chapter").agg(F.count("*").alias("c"))
    one = lambda d: F.sum(F.when(F.col("difficulty") == d, F.col("c")).otherwise(0)).alias(d)
    return cells.agg(
        F.sum("c").alias("total_questions"), F.countDistinct("exam_set").alias("total_sets"),
        one("easy"), one("medium"), one("hard"), F.countDistinct("chapter").alias("chapters_covered"),
    )


def filter_values(bank: DataFrame) -> DataFrame:
    """Distinct values of every filter, one row each; the caller sorts what it shows."""
    cells = bank.select("chapter", "difficulty", "bloom_level").distinct()
    return (
        cells.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(n).alias("filter_name"), F.col(n).alias("value"))
                        for n in ("chapter", "difficulty", "bloom_level")
                    ]
                )
            )
        )
        .where("value IS NOT NULL AND value <> ''")
        .distinct()
    )


def breakdown(bank: DataFrame) -> DataFrame:
    return bank.groupBy("exam_set", "chapter", "difficulty").agg(F.count("*").alias("n"))


def read_set(bank: DataFrame, exam_set: int) -> DataFrame:
    return bank.where(F.col("exam_set") == exam_set).orderBy("id")


def answer_key(bank: DataFrame) -> DataFrame:
    """Numbered answers of every set."""
    numbered = row_numbers(bank.select("exam_set", "id", "question", "correct_answer", "difficulty", "chapter"), ["exam_set"], "id", "q_no")
    return numbered.select("exam_set", "q_no", "question", "correct_answer", "difficulty", "chapter")


def print_listing(bank: DataFrame) -> DataFrame:
    """Every question with its set's latest date; the date is aggregated, not windowed."""
    dates = bank.groupBy("exam_set").agg(F.max("created_epoch").alias("set_epoch"))
    return bank.join(dates, "exam_set").select(
        "exam_set", "id", "question", *[F.get("options", F.lit(i)).alias(f"option_{n}") for i, n in enumerate("abcd")],
        "correct_answer", "difficulty", "bloom_level", "chapter", "set_epoch",
    )


def to_flat_options(bank: DataFrame) -> DataFrame:
    return bank.select(
        *[c for c in bank.columns if c != "options"],
        *[F.get("options", F.lit(i)).alias(f"option_{n}") for i, n in enumerate("abcd")],
    )


def to_option_list(bank: DataFrame) -> DataFrame:
    names = [f"option_{n}" for n in "abcd"]
    return bank.withColumn("options", F.array(*names)).drop(*names)


def new_rows(bank: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows that an insert row by row would keep, in order of id, uuid and hash.

    A row is kept if neither its uuid nor its content hash is in the bank or belongs to an
    earlier kept row; a null uuid is nobody's. Rows known to the bank go first, so they block nobody. Rows
    of one id are rows of their own; of rows that have id, uuid and hash in common the one with the
    smallest hash of the whole row is kept.
    """
    keys, order = ["question_uuid", "question_hash"], ["_at", "_uuid", "question_hash"]
    own = [c for c in incoming.columns if c != "question_hash"]
    keyed = incoming.withColumns(
        {
            "question_hash": X.content_hash(F.col("question")), "_uuid": F.coalesce("question_uuid", F.lit("")),
            "_at": F.coalesce("id", F.lit(2**63 - 1)),  # rows without an id come last
        }
    )
    keyed = keyed.withColumn("_digest", F.xxhash64(F.to_json(F.struct(own))))
    # Only keys are settled; whole rows meet the kept keys once, and columns nobody asks for are not moved.
    fresh = keyed.groupBy(*order).agg(F.min(F.struct("_digest", "question_uuid")).alias("_m")).select(*order, "_m.*")
    known = bank.select("question_uuid", X.content_hash(F.col("question")).alias("question_hash"))
    for key in keys:
        fresh = fresh.join(known.select(key).distinct(), key, "left_anti")
    fresh = cut_lineage(fresh)
    kept = first_of_keys(fresh.select(*order, "question_uuid"), order, *keys).select(order)
    row = [*order, "_digest"]
    one = keyed.join(fresh.join(kept, order).select(row), row, "left_semi").dropDuplicates(row)
    return one.select("question_hash", "question_uuid", *[c for c in own if c != "question_uuid"])


def rejection_log(rejected: DataFrame) -> DataFrame:
    """Log rows with the id and the time they are read back by; the validator's name is cut
    to its 60 characters."""
    return rejected.select(
        "id", "created_epoch", "question_uuid", "exam_set", "chapter", F.col("question").alias("question_text"),
        "correct_answer", "difficulty", X.cut(F.col("validator_failed"), 60).alias("validator_failed"), "reason",
    )


def newest_log(log: DataFrame, limit: int = 100, validator: str | None = None, chapter: str | None = None) -> DataFrame:
    """Newest entries first (a top-n, not a sort of the log)."""
    if validator is not None:
        log = log.where(F.col("validator_failed") == validator)
    if chapter is not None:
        log = log.where(F.col("chapter") == chapter)
    return log.orderBy(F.desc("created_epoch"), F.desc("id")).limit(limit)


# Defaults of columns that older banks lack.
EVOLVED = {
    "bloom_level": "remember",
    "weightage": 1.0,
    "question_type": "standard",
    "model_name": "",
    "prompt_version": "v1",
    "generation_time": 0.0,
    "retry_count": 0,
}


def evolve(old: DataFrame) -> DataFrame:
    """Bring an older bank to the present columns: defaults, uuid and hash filled in."""
    df = old
    for name, default in EVOLVED.items():
        value = F.lit(default)
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    if "tags" not in df.columns:
        df = df.withColumn("tags", F.array().cast("array<string>"))
    for name, filled in (("question_uuid", F.uuid()), ("question_hash", X.content_hash(F.col("question")))):
        df = df.withColumn(name, F.coalesce(F.col(name), filled) if name in df.columns else filled)
    return df


def merge_banks(new: DataFrame, old: DataFrame) -> DataFrame:
    """Union by name; columns one side lacks become null there."""
    return new.unionByName(old, allowMissingColumns=True)


def drop_set(bank: DataFrame, exam_set: int) -> DataFrame:
    return bank.where(F.col("exam_set") != exam_set)


def set_documents(bank: DataFrame, course: str = "course", part_rows: int = PART_ROWS) -> DataFrame:
    """One nested document per set, questions in order.

    A set of the normal size is one document. A set beyond ``part_rows`` is written
    in numbered parts, so no document (and no task) holds an unbounded set; every document
    says how many parts its set has.
    """
    numbered = row_numbers(bank, ["exam_set"], "id", "q_no").withColumn(
        "part", F.floor((F.col("q_no") - 1) / part_rows).cast("int")
    )
    sizes = bank.groupBy("exam_set").agg(F.count("*").alias("total_questions"), F.max("created_epoch").alias("generated_epoch"))
    fields = ["q_no", *[c for c in bank.columns if c != "exam_set"]]
    nested = numbered.groupBy("exam_set", "part").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("questions")
    )
    return nested.join(sizes, "exam_set").select(
        "exam_set", "part", F.ceil(F.col("total_questions") / part_rows).cast("int").alias("n_parts"),
        F.lit(course).alias("course"), "total_questions", "generated_epoch", "questions"
    )


def answer_key_documents(bank: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    key = answer_key(bank).withColumn("part", F.floor((F.col("q_no") - 1) / part_rows).cast("int"))
    sizes = bank.groupBy("exam_set").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("n_parts"))
    nested = key.groupBy("exam_set", "part").agg(
        F.sort_array(F.collect_list(F.struct("q_no", "question", "correct_answer", "difficulty", "chapter"))).alias("answer_key")
    )
    return nested.join(sizes, "exam_set").select("exam_set", "part", "n_parts", "answer_key")


def combined_header(bank: DataFrame, course: str = "course") -> DataFrame:
    """Head of the combined export; its sets are the documents of ``set_documents``."""
    sizes = bank.groupBy("exam_set").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("total_sets"), F.min_by("n", "exam_set").alias("questions_per_set")
    ).withColumn("course", F.lit(course))


def write_combined(bank: DataFrame, path: str, generated_at: Column | None = None, course: str = "course", part_rows: int = PART_ROWS) -> None:
    """Combined export below ``path``: ``header`` (one JSON document with course, totals and ``generated_at``, an
    aggregate of the bank, else the time of the call) and ``exam_sets`` (a folder a set, whose numbered parts hold its questions)."""
    sizes = bank.groupBy("exam_set").agg(F.count("*").alias("n"), *([generated_at.alias("_at")] if generated_at is not None else []))
    at = F.max("_at") if generated_at is not None else F.date_format(F.first(F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss")
    head = sizes.agg(F.count("*").alias("total_sets"), F.min_by("n", "exam_set").alias("questions_per_set"), at.cast("string").alias("generated_at"))
    head.withColumn("course", F.lit(course)).coalesce(1).write.json(f"{path}/header")
    sets = set_documents(bank, course, part_rows).select(F.col("exam_set").alias("set_number"), "part", "n_parts", "questions")
    sets.write.partitionBy("set_number").json(f"{path}/exam_sets")


def read_combined(spark: SparkSession, path: str, questions: str = "q_no bigint, id bigint, question string") -> DataFrame:
    """Parts of a combined export with its header on each: ``questions`` names the fields that are read."""
    head = spark.read.schema("course string, total_sets bigint, questions_per_set bigint, generated_at string").json(f"{path}/header").first()
    sets = spark.read.schema(f"set_number int, part int, n_parts int, questions array<struct<{', '.join(c.replace(' ', ': ', 1) for c in questions.split(', '))}>>")
    return sets.json(f"{path}/exam_sets").withColumns({c: F.lit(head[c]) for c in head.__fields__})


def shuffled(bank: DataFrame) -> DataFrame:
    """Reproducible order per set: by a hash of uuid and set, numbered from 1."""
    seeded = bank.withColumn("shuffle_key", X.stable_number("question_uuid", "exam_set"))
    # The 60-bit key is cut into ranges; its top digits make evenly filled buckets.
    return row_numbers(seeded, ["exam_set"], "shuffle_key", "shuffled_no", width=2**50)
