"""The registered queries opN_<name>: thin projections of the operators over whole tables."""

from __future__ import annotations

from sagebrush.llm.common import prepare, table

QUERIES: dict = {}


def query(name: str):
    def deco(fn):
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


@query("op9_decontaminate")
def _op9(spark, sf_dir):
    """Words of documents that lie in a ten-word window of a benchmark item."""
    from sagebrush.llm.decontaminate import op9_decontaminate

    return op9_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_exact_dedup")
def _op7(spark, sf_dir):
    """The group of equal texts of every document, and the row of it that stays."""
    from sagebrush.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def _op2(spark, sf_dir):
    """The language of every document, learned from the documents outside the held-out fold."""
    from pyspark.sql import functions as F

    from sagebrush.llm.common import fold
    from sagebrush.llm.language import learn_profiles, predict

    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return predict(rows, learn_profiles(docs.filter(~held_out))).drop("text")


@query("op5_toxicity")
def _op5(spark, sf_dir):
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    from pyspark.sql import functions as F

    from sagebrush.llm.common import fold
    from sagebrush.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return score(docs, learn(docs, labels.filter(fold(F.col("doc_id"), 3) != 1)), held_out)


@query("op8_simhash")
def _op8(spark, sf_dir):
    """SimHash fingerprint and near-duplicate component of every document."""
    from sagebrush.llm.simhash import op8_simhash

    return op8_simhash(table(spark, sf_dir, "documents"))


@query("op4_token_output")
def _op4(spark, sf_dir):
    """Place, length and checksum of every document's token ids, read back from the written files."""
    from sagebrush.llm.token_output import op4_token_output

    return op4_token_output(table(spark, sf_dir, "documents"))


@query("op6_mix_sources")
def _op6(spark, sf_dir):
    """Every draw of the mixture: document, source, its tokens, epoch and block."""
    from sagebrush.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "epoch", "block")


@query("op1_line_dedup")
def _op1(spark, sf_dir):
    """Lines and removed lines of every document, and the digest of what is left of its text."""
    from pyspark.sql import functions as F

    from sagebrush.llm.line_dedup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents"), min_chars=1)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op3_lm_score")
def _op3(spark, sf_dir):
    """Kneser-Ney trigram and unigram log10 probability of every document, learned outside the held-out fold."""
    from pyspark.sql import functions as F

    from sagebrush.llm.common import fold
    from sagebrush.llm.lm import score

    return score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 1, order=3)


@query("op10_suffix_dedup")
def _op10(spark, sf_dir):
    """Bytes of every document in 100-byte strings that start earlier, and the digest of the others."""
    from sagebrush.llm.repeats import op10_repeats

    return op10_repeats(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def _op11(spark, sf_dir):
    """Whitened coordinates of every embedding along the first 32 components."""
    from sagebrush.llm.whitening import op11_whitening

    return op11_whitening(table(spark, sf_dir, "embeddings"))


@query("op12_secrets")
def _op12(spark, sf_dir):
    """Secrets of every document: plain patterns, and keys and tokens confirmed by their structure."""
    from sagebrush.llm.secrets import op12_secrets

    return op12_secrets(table(spark, sf_dir, "documents"))


@query("op13_collocations")
def _op13(spark, sf_dir):
    """The first 2000 phrases of every language by the cohesion of their loosest cut."""
    from sagebrush.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))
