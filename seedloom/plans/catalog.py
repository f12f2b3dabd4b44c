"""The queries of the core over a data folder, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.functions.text import letter
from seedloom.operators import augment, batches, keyed, mcq, metrics, packed_values, prompts, qa, ranking, retrieval, shred, vectors
from seedloom.operators.providers import BatchProvider, RuleProvider, stub_batch
from seedloom.plans.sql import ORACLES
from seedloom.schemas import MULTIPLE_CHOICE, QUESTION_ANSWER
from seedloom.session import shared_dir, table
from seedloom.sources import seeds, sinks

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return packed_values.options_of(table(spark, d, "examples"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.all_nodes(table(spark, d, "instruction_files"), "record_id", "raw_json")


def _p5(spark: SparkSession, d: str, name: str) -> DataFrame:
    return shred.flat_tables(table(spark, d, "instruction_files"), "record_id", "raw_json", names=(name,))[name]


def p5_task(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d, "task")


def p5_category(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d, "category")


def p5_definition(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d, "definition")


def p5_positive(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d, "positive")


def p5_negative(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d, "negative")


def p5_variant(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d, "variant")


def p5_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d, "shuffle")


def p5_rejects(spark: SparkSession, d: str) -> DataFrame:
    return shred.rejects(table(spark, d, "instruction_files"), "record_id", "raw_json")


def _mc(spark: SparkSession, d: str) -> DataFrame:
    return mcq.parse(seeds.example_seeds(table(spark, d, "examples"), MULTIPLE_CHOICE))


def _qa(spark: SparkSession, d: str) -> DataFrame:
    return qa.parse(seeds.example_seeds(table(spark, d, "examples"), QUESTION_ANSWER))


def _one_per_id(spark: SparkSession, d: str) -> DataFrame:
    """Examples of both polarities, one per example_id (the earliest)."""
    rows = table(spark, d, "examples").where("example_id is not null")
    columns = {c: F.col(c) for c in ("file", "task_kind", "polarity", "input", "output", "explanation")}
    return keyed.one_per_id(rows, "example_id", F.col("loaded_at"), keyed.content_hash(*columns.values()), columns)


def mc_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = mcq.valid(_mc(spark, d))
    return rows.select("seed_ord", "head", "tail", *[F.element_at("options", k + 1).alias(f"option_{'abcd'[k]}") for k in range(4)], "answer_idx", "labels_ok")


def qa_parse(spark: SparkSession, d: str) -> DataFrame:
    return mcq.valid(_qa(spark, d)).select("seed_ord", "head", "fact", "question")


def parse_rejects(spark: SparkSession, d: str) -> DataFrame:
    both = [mcq.rejects(x).select("task_kind", "reason") for x in (_mc(spark, d), _qa(spark, d))]
    return both[0].unionByName(both[1]).groupBy("task_kind", "reason").agg(F.count("*").alias("n"))


def mc_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return mcq.shuffled(mcq.valid(_mc(spark, d)), 0, F.col("seed_ord")).select("seed_ord", "input", "output")


def mc_distractors(spark: SparkSession, d: str) -> DataFrame:
    rows = mcq.valid(_mc(spark, d))
    return rows.select("seed_ord", "output", F.posexplode(mcq.wrong_letters(F.col("output"), 0, F.lit("M1"), F.col("seed_ord"))).alias("neg_slot", "wrong"))


_SHOWN = ("file", "branch", "seed_ord", "variant", "shuffle", "neg_slot", "input", "output", "explanation")


def _augmented(spark: SparkSession, d: str, task: str, which: int) -> DataFrame:
    if task == "mc":
        return augment.multiple_choice(mcq.valid(_mc(spark, d)), RuleProvider())[which].select(*_SHOWN)
    return augment.question_answer(mcq.valid(_qa(spark, d)), RuleProvider())[which].select(*_SHOWN)


def mc_augment_pos(spark: SparkSession, d: str) -> DataFrame:
    return _augmented(spark, d, "mc", 0)


def mc_augment_neg(spark: SparkSession, d: str) -> DataFrame:
    return _augmented(spark, d, "mc", 1)


def qa_augment_pos(spark: SparkSession, d: str) -> DataFrame:
    return _augmented(spark, d, "qa", 0)


def qa_augment_neg(spark: SparkSession, d: str) -> DataFrame:
    return _augmented(spark, d, "qa", 1)


def augment_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = augment.augment(mcq.valid(_mc(spark, d)), mcq.valid(_qa(spark, d)), RuleProvider())
    return rows.groupBy("task_kind", "polarity", "branch").agg(F.count("*").alias("n"))


def prompt_corpus(spark: SparkSession, d: str) -> DataFrame:
    return prompts.corpus(_one_per_id(spark, d)).select("example_id", F.coalesce("file", F.lit("")).alias("file"), "task_ord", "polarity_ord", "prompt")


def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _one_per_id(spark, d).select("example_id")
    return keyed.exact_holdout(rows, ["example_id"], 0.2)


def head_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = prompts.corpus(_one_per_id(spark, d))
    return batches.batched_head(rows, ["example_id"], 10, 4).select("example_id", "prompt", "batch")


def row_by_index(spark: SparkSession, d: str) -> DataFrame:
    return keyed.numbered(_one_per_id(spark, d).select("example_id", "polarity"), ["example_id"])


def option_top3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "option_scores").select("example_id", ranking.top_letters(F.col("scores")).alias("top3"))


def option_hits(spark: SparkSession, d: str) -> DataFrame:
    """Whether the best option is the one that was predicted."""
    rows = table(spark, d, "option_scores").withColumn("best", ranking.top_letters(F.col("scores"), 1))
    return rows.groupBy("best", "pred").agg(F.count("*").alias("n"))


def _rouge(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rouge(table(spark, d, "eval_pair"), "pair_id", "prediction", "reference")


def rouge1(spark: SparkSession, d: str) -> DataFrame:
    return _rouge(spark, d).select("pair_id", F.round("rouge1", 6).alias("f1"))


def rouge2(spark: SparkSession, d: str) -> DataFrame:
    return _rouge(spark, d).select("pair_id", F.round("rouge2", 6).alias("f1"))


def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return _rouge(spark, d).select("pair_id", F.round("rougeL", 6).alias("rouge_l"), F.round("rougeLsum", 6).alias("rouge_l_sum"))


def rouge(spark: SparkSession, d: str) -> DataFrame:
    """The mean of each measure over all pairs."""
    return _rouge(spark, d).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("rouge1", "rouge2", "rougeL", "rougeLsum")], F.count("*").alias("pairs"))


def bleu(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bleu(table(spark, d, "eval_pair"), "prediction", "reference").select(F.round("bleu", 9).alias("bleu"), "pairs")


def bertscore(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.bertscore(table(spark, d, "eval_pair"), "pair_id", "prediction", "reference")
    return rows.select("pair_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def mean_f1(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.bertscore(table(spark, d, "eval_pair"), "pair_id", "prediction", "reference")
    return rows.agg(F.round(F.avg("f1"), 6).alias("mean_f1"))


def token_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Token vectors fitted on all documents, as text."""
    rows = vectors.fit_token_vectors(table(spark, d, "documents"), "text")
    return rows.select("token", "n", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), " ").alias("vector"))


def bertscore_fitted(spark: SparkSession, d: str) -> DataFrame:
    """Greedy matching with the vectors fitted on the documents."""
    each, _ = vectors.token_model(vectors.fit_token_vectors(table(spark, d, "documents"), "text"))
    rows = metrics.bertscore(table(spark, d, "eval_pair"), "pair_id", "prediction", "reference", each)
    return rows.select("pair_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def loss_series(spark: SparkSession, d: str) -> DataFrame:
    return metrics.loss_series(table(spark, d, "train_log"), "run_id")


def trainer_state_read(spark: SparkSession, d: str) -> DataFrame:
    """The logs written as one trainer state a run, and read back."""
    path = shared_dir(spark, "trainer-states")
    rows = table(spark, d, "train_log").select("run_id", F.to_json(F.struct("log_history"), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.option("maxRecordsPerFile", 1).partitionBy("run_id").text(path)
    return metrics.loss_series(seeds.read_trainer_state(spark, path), "run_id")


def page_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval.page_documents(retrieval.latest_pages(table(spark, d, "page_item")))
    return rows.select("page_id", "page_content", F.col("metadata")["source"].alias("source"))


def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    pages = retrieval.latest_pages(table(spark, d, "page_item"))
    return pages.select("page_id", F.posexplode(retrieval.fixed_chunks("text", 200)).alias("chunk_no", "chunk"))


def page_chunks_recursive(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.chunks(retrieval.latest_pages(table(spark, d, "page_item")), "page_id", "text")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "embeddings")
    found = retrieval.vector_topk(base, base.where("vec_id % 100 = 0"), "vec_id", "embedding")
    return found.select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


def rag_context(spark: SparkSession, d: str) -> DataFrame:
    """Contexts from chunks of 200 characters, so that most pages have several."""
    pages = retrieval.latest_pages(table(spark, d, "page_item"))
    cuts = pages.select("page_id", F.posexplode(retrieval.fixed_chunks("text", 200)).alias("chunk_no", "chunk"))
    return retrieval.contexts(pages, F.col("page_id") % 100 == 0, cuts=cuts)


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalog").where("website is not null").groupBy("file").agg(F.min("website").alias("website"))


def seed_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = mcq.valid(_qa(spark, d)).select("file", "seed_ord", "input", "output", "explanation")
    return batches.seed_prompts(rows, _sites(spark, d))


def written_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds read back from an answer per file that gives its parsed seeds one object after the other, each with a comma."""
    rows = mcq.valid(_qa(spark, d))
    said = F.concat(F.to_json(F.struct(F.col("input").alias("Input"), F.col("output").alias("Output"), F.col("explanation").alias("Explanation"))), F.lit(",\n"))
    answers = rows.groupBy("file", F.floor(F.col("seed_ord") / 100).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seed_ord", said.alias("t")))), lambda x: x["t"]), "").alias("answer"))
    return batches.written_seeds(answers, "answer", "file", "part")


def provider_requests(spark: SparkSession, d: str) -> DataFrame:
    """What a model is asked for the explanation of each multiple-choice seed, with the address its file is about."""
    rows = mcq.valid(_mc(spark, d)).join(_sites(spark, d), "file", "left")
    provider = BatchProvider(lambda: stub_batch)
    asked = provider.asked(rows, "paraphrase_explanation", F.lit(2), F.struct("input", "output", "explanation"), F.col("explanation"), key=("file", "task_kind", "seed_ord"))
    return provider.requests(asked, "paraphrase_explanation")


def catalog_lookup(spark: SparkSession, d: str) -> DataFrame:
    counts = _one_per_id(spark, d).groupBy("file").agg(F.count("*").alias("n"))
    return counts.join(table(spark, d, "catalog").select("file", "website"), "file")


def nested_export(spark: SparkSession, d: str) -> DataFrame:
    rows = _one_per_id(spark, d).where("input is not null and output is not null")
    docs = sinks.nested_documents(rows)
    said = {c: F.md5(F.array_join(F.transform(c, lambda e: F.concat_ws("|", e["Input"], e["Output"], e["Explanation"])), "\n")) for c in ("positives", "negatives")}
    return docs.select("file", "part", "task_kind", *[F.size(c).alias(c) for c in said], *[x.alias(f"{c}_digest") for c, x in said.items()])


def file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Examples written as instruction files, with the definitions that deliveries give, and read back."""
    rows = _one_per_id(spark, d).where("input is not null and output is not null")
    deliveries = table(spark, d, "instruction_files")
    parts = shred.flat_tables(deliveries, "record_id", "raw_json", names=("category", "definition"))
    kinds, texts = (parts[n].select("record_id", "parent_path", F.col("value").alias(c)) for n, c in (("category", "task_kind"), ("definition", "definition")))
    files = deliveries.where("file is not null").select("record_id", "file")
    definitions = kinds.join(texts, ["record_id", "parent_path"]).join(files, "record_id").groupBy("file", "task_kind").agg(F.min("definition").alias("definition"))
    path = shared_dir(spark, "instruction-files")
    sinks.write_instruction_files(sinks.file_documents(rows, definitions, 100_000), path)
    tasks = seeds.read_tasks(spark, path)
    said = tasks.select("file", F.col("`Instruction information`.Categories").alias("task_kind"), F.col("Definition").alias("definition"))
    both = [seeds.task_seeds(tasks, f"{p.title()} Example").withColumn("polarity", F.lit(p)) for p in ("positive", "negative")]
    return both[0].unionByName(both[1]).join(said.groupBy("file", "task_kind").agg(F.min("definition").alias("definition")), ["file", "task_kind"])


def answer_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = mcq.valid(_mc(spark, d))
    return rows.groupBy("file", letter(F.col("answer_idx")).alias("answer")).agg(F.count("*").alias("n"))


def answer_containment(spark: SparkSession, d: str) -> DataFrame:
    rows = mcq.valid(_qa(spark, d))
    kind = F.when(F.contains("fact", "output"), "exact").when(F.contains(F.lower("fact"), F.lower("output")), "ignoring case").otherwise("no")
    return rows.groupBy("file", kind.alias("contained")).agg(F.count("*").alias("n"))


_QUERIES: tuple[Query, ...] = (
    p1_found, p5_found, p5_task, p5_category, p5_definition, p5_positive, p5_negative, p5_variant, p5_shuffle, p5_rejects, mc_parse, qa_parse, parse_rejects, mc_shuffle, mc_distractors, mc_augment_pos, mc_augment_neg, qa_augment_pos, qa_augment_neg, augment_counts,
    prompt_corpus, holdout_split, head_batches, row_by_index, option_top3, option_hits, rouge1, rouge2, rouge_l, rouge, bleu, bertscore, mean_f1, token_vectors, bertscore_fitted, loss_series, trainer_state_read, page_documents, page_chunks,
    page_chunks_recursive, vector_topk, rag_context, seed_prompt, written_seeds, provider_requests, catalog_lookup, nested_export, file_round_trip, answer_distribution, answer_containment,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
