"""The linkage pipelines end to end: fields, dictionary, parameters, learning, decoding, evaluation."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.config import Options
from reclink.functions.text import from_bio
from reclink.operators import blocking, evaluate, fields, lattice, learn
from reclink.operators.constraints import Domain, citation_domain, constrained_decode, hotel_domain
from reclink.operators.fields import CITATION_FIELDS, HOTEL_FIELDS, Field
from reclink.session import written
from reclink.sources.mentions import mentions_of


@dataclass
class Run:
    """What a pipeline has built and learnt so far."""

    setting: learn.Setting
    fields: list[Field]
    values: DataFrame
    params: DataFrame
    domain: Domain
    joint: DataFrame | None = None

    @property
    def chain(self) -> lattice.Chain:
        return lattice.Chain.of(self.params, self.setting.labels)


def labels_of(mentions: DataFrame) -> list[str]:
    """Labels in the order of their names, O first."""
    rows = mentions.select(F.explode(from_bio(F.col("labels"))).alias("s")).select(F.col("s.label").alias("label")).distinct().collect()
    return ["O", *sorted(r["label"] for r in rows if r["label"] != "O")]


def prepare(examples: DataFrame, known_fields: list[Field], options: Options | None = None, domain: str = "hotel", label_source: DataFrame | None = None) -> Run:
    """Values, index lengths, dictionary and initial parameters of examples (see ``plans.examples``)."""
    options = options or Options()
    examples = mentions_of(examples, options.max_records, options.max_texts)
    # features are read by every iteration
    examples = written(examples, "examples")
    labels = labels_of(examples.where("is_record").unionByName(label_source, True) if label_source is not None else examples.where("is_record"))
    of = {f.name: f for f in known_fields}
    own = [of.get(x) or fields.citation_field(x) for x in labels]
    values = written(fields.field_values(examples.where("is_record"), own), "values")
    longest = fields.max_lengths(values, own)
    keys = written(learn.parameter_keys(examples, labels, options.feature_threshold, options.feature_threshold), "keys")
    params = written(learn.hotel_initial(keys) if domain == "hotel" else learn.initial(keys), "params")
    rules = hotel_domain(own) if domain == "hotel" else citation_domain(own)
    return Run(learn.Setting(examples, keys, labels, longest, options, rules if options.constrained_learning else learn.PLAIN), own, values, params, rules)


def with_joint(run: Run) -> Run:
    """Adds the candidate records of texts (all key fields) and their values; learning is under the domain's constraints if the options say so."""
    texts = run.setting.texts()
    pairs = blocking.conjunctive(texts, run.setting.records(), run.values, run.fields, run.setting.longest)
    joint = written(lattice.with_candidates(texts, pairs, run.values), "joint")
    return replace(run, joint=joint, setting=replace(run.setting, candidates=joint.select("mention_id", "candidates")))


def segmentation(run: Run, use_gen: bool = True, use_disc: bool = False, constrained: bool | None = None, rows: DataFrame | None = None) -> DataFrame:
    """(mention_id, words, truth, guess) of texts; punctuation at the ends of segments is O on both sides. Constraints hold if asked for, or else by the options."""
    constrained = run.setting.options.constrained_inference if constrained is None else constrained
    texts = run.setting.texts() if rows is None else rows
    ready = lattice.scored(texts, run.params, run.setting.labels, use_gen, use_disc)
    if constrained:
        found = constrained_decode(ready, run.chain, run.setting.longest, run.domain, None, use_gen, use_disc, only_segmentation=True)
        found = found.select("mention_id", F.transform("segments", lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["label"].alias("label"))).alias("segments"))
    else:
        found = lattice.decode(ready, run.chain, run.setting.longest, use_gen, use_disc)
    joined = texts.select(F.col("mention_id").cast("string").alias("mention_id"), "words", "labels").join(found, "mention_id")
    return joined.select("mention_id", "words", evaluate.adjusted(F.col("words"), from_bio(F.col("labels"))).alias("truth"), evaluate.adjusted(F.col("words"), F.col("segments")).alias("guess"))


def joint_decoding(run: Run, use_gen: bool = True, use_disc: bool = False, constrained: bool | None = None, state: DataFrame | None = None) -> DataFrame:
    """``decode_joint`` of texts, with their true clusters. Constraints hold if asked for, or else by the options."""
    constrained = run.setting.options.constrained_inference if constrained is None else constrained
    ready = lattice.scored(run.joint, run.params, run.setting.labels, use_gen, use_disc)
    if constrained:
        found = constrained_decode(ready, run.chain, run.setting.longest, run.domain, state, use_gen, use_disc)
    else:
        found = lattice.decode_joint(ready, run.chain, run.setting.longest, use_gen, use_disc)
    return found.join(run.joint.select(F.col("mention_id").cast("string").alias("mention_id"), "true_cluster"), "mention_id")


def joint_report(run: Run, predictions: DataFrame) -> DataFrame:
    """Coreference quality of joint predictions."""
    return evaluate.coref_scores(evaluate.with_clusters(predictions.select("mention_id", "true_cluster", "record_id"), run.setting.records().select(F.col("mention_id").cast("string").alias("mention_id"), "true_cluster")))


def hotels(examples: DataFrame, options: Options | None = None) -> tuple[Run, dict[str, DataFrame]]:
    """The hotel pipeline, and its reports by name."""
    o = options or Options()
    run, reports = prepare(examples, HOTEL_FIELDS, o, "hotel"), {}
    if o.seg_gen_iterations:
        run.params, _ = learn.em(run.setting, run.params, o.seg_gen_iterations)
    if o.seg_disc_iterations:
        run.params, _ = learn.fit_weights(run.setting, run.params, o.seg_disc_iterations)
    if o.seg_kl_iterations:
        run.params, _ = learn.fit_weights(run.setting, run.params, o.seg_kl_iterations, use_gen=True, kl=True)
    models = [("gen", True, False)] * bool(o.seg_gen_iterations) + [("disc", False, True)] * bool(o.seg_disc_iterations or o.seg_kl_iterations)
    for name, gen, disc in models:
        for constrained in (False, True):
            reports[f"segmentation.{name}{'.constrained' * constrained}"] = evaluate.span_scores(segmentation(run, gen, disc, constrained))
    run = with_joint(run)
    if o.coref_gen_iterations:
        # this learner's texts take part by the weight of the segmentation
        run.params, _ = learn.em(run.setting, run.params, o.coref_gen_iterations, joint=True, text_gate=o.seg_text_weight)
    if o.coref_disc_iterations:
        from reclink.sources.mentions import batches

        rows = batches(run.setting.examples.select("mention_id"), "mention_id", o.batch_size)
        run.params, _ = learn.mini_batches(run.setting, run.params, rows, o.coref_disc_iterations, joint=True)
    if o.coref_kl_iterations:
        run.params, _ = learn.fit_weights(run.setting, run.params, o.coref_kl_iterations, use_gen=True, kl=True)
    for name, gen, disc in models:
        for constrained in (False, True):
            reports[f"joint.{name}{'.constrained' * constrained}"] = joint_report(run, joint_decoding(run, gen, disc, constrained))
    return run, reports


def citations(examples: DataFrame, options: Options | None = None, held_out: DataFrame | None = None) -> tuple[Run, dict[str, DataFrame]]:
    """The citation pipeline: one pass on records alone first, online learners as mini-batches, evaluation on held-out texts."""
    o = options or Options()
    run, reports = prepare(examples, CITATION_FIELDS, o, "citation", held_out), {}
    records_only = replace(run.setting, options=replace(o, seg_text_weight=0.0))
    run.params, _ = learn.em(records_only, run.params, 1)
    if o.seg_gen_iterations:
        run.params, _ = learn.em(run.setting, run.params, o.seg_gen_iterations)
    batches = learn.shuffled_batches(run.setting.examples, o.batch_size, o.seed) if o.seg_disc_iterations or o.seg_kl_iterations or o.coref_disc_iterations else None
    if o.seg_disc_iterations:
        run.params, _ = learn.mini_batches(run.setting, run.params, batches, o.seg_disc_iterations)
    if o.seg_kl_iterations:
        run.params, _ = learn.mini_batches(run.setting, run.params, batches, o.seg_kl_iterations, use_gen=True, kl=True)
    models = [("gen", True, False)] + [("disc", False, True)] * bool(o.seg_disc_iterations or o.seg_kl_iterations)
    for name, gen, disc in models:
        for constrained in (False, True):
            reports[f"segmentation.{name}{'.constrained' * constrained}"] = evaluate.span_scores(segmentation(run, gen, disc, constrained, held_out))
    run = with_joint(run)
    if o.coref_gen_iterations:
        run.params, _ = learn.em(run.setting, run.params, o.coref_gen_iterations, joint=True, text_gate=o.seg_text_weight)
    if o.coref_disc_iterations:
        run.params, _ = learn.mini_batches(run.setting, run.params, batches, o.coref_disc_iterations, joint=True)
    for name, gen, disc in models:
        for constrained in (False, True):
            reports[f"joint.{name}{'.constrained' * constrained}"] = joint_report(run, joint_decoding(run, gen, disc, constrained))
    return run, reports


def supervised(examples: DataFrame, test: DataFrame, options: Options | None = None, longest: int = 1000) -> tuple[Run, DataFrame]:
    """Labelled texts alone: generative counts, then weights; every field may be up to ``longest`` words.  Token scores on ``test``."""
    o = options or Options()
    run = prepare(examples.withColumn("is_record", F.lit(True)), CITATION_FIELDS, o, "citation", test)
    texts = run.setting.examples.withColumn("is_record", F.lit(False))
    run.setting = replace(run.setting, examples=texts, longest=dict.fromkeys(run.setting.labels, longest))
    run.params, _ = learn.em(run.setting, run.params, 1, supervised=True)
    if o.seg_disc_iterations:
        run.params, _ = learn.fit_weights(run.setting, run.params, o.seg_disc_iterations, supervised=True)
    scored_by = (not o.seg_disc_iterations, bool(o.seg_disc_iterations))
    return run, evaluate.token_scores(segmentation(run, *scored_by, rows=test))
