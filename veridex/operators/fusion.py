"""Fusion of observations (image_id, ord, value, format, engine, variant, decode_ms, engine_confidence) into ranked candidates.

The order of observations within an image is that of ord. Confidences are integers of thousandths, so that ranks
and cutoffs compare exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridex import dims
from veridex.functions import formats as fmt
from veridex.functions.net import let
from veridex.functions.rates import fixed
from veridex.shipping import ship


def _weight() -> Column:
    valid = fmt.payload_valid(F.col("value"), F.col("format"))
    gtin = fmt.payload_kind(F.col("format")) == "gtin"
    one = F.when(valid, F.when(gtin, 3.0).otherwise(2.0)).otherwise(F.when(gtin, 1.0).otherwise(0.5))  # valid stands once, as branches share no work
    return F.when(F.col("format") != "UNKNOWN", one)


def _paid(obs: DataFrame) -> DataFrame:
    """Adds the trimmed payload and drops observations without one.

    Through a generator, or Spark would put all that makes a value into the filter as often as the value's expression
    names it, in code too long for the JVM to compile.
    """
    return obs.drop("payload").select("*", F.inline(F.array(F.struct(F.trim("value").alias("payload"))))).filter("payload <> ''")


def groups(obs: DataFrame) -> DataFrame:
    """One row per image, class of code and trimmed payload, with what its observations say."""
    if "engine_confidence" not in obs.columns:
        obs = obs.withColumn("engine_confidence", F.lit(None).cast("double"))
    o = _paid(obs).withColumn("class", F.when(F.col("format").isin(dims.FUSION_2D_FORMATS), "2D").otherwise("1D"))
    # fixed-width buffers first, so that rows are combined in hash maps before the one list of each payload is made
    per = o.groupBy("image_id", "class", "payload", "value", "format", "engine", "variant").agg(F.min("ord").alias("first"), F.count("*").alias("n"), F.min("decode_ms").alias("fastest"), F.max("engine_confidence").alias("own"))
    per = per.withColumn("w", _weight() * F.col("n"))  # depends on value and format only
    listed = F.collect_list(F.struct("first", "value", "format", "engine", "variant", "w", "n", "fastest", "own"))
    g = per.groupBy("image_id", "class", "payload").agg(listed.alias("r")).select("image_id", "class", "payload", let(F.array_sort("r"), _summary).alias("s"))
    return g.select("image_id", "class", "payload", "s.*").withColumn("agreement", F.size("engines"))


def _summary(r: Column) -> Column:
    """What the combined observations of one payload, in order, say together."""
    named = lambda c: F.transform(r, lambda x: x[c])
    bonus = lambda f: F.when(f == "EAN-13", 0.1).when(f == "EAN-8", 0.05).otherwise(0.0)
    total = lambda f: F.aggregate(F.filter(r, lambda x: x["format"] == f), F.lit(0.0), lambda acc, x: acc + x["w"]) + bonus(f)
    score = lambda f, i: F.struct(total(f).alias("score"), (-i).alias("early"), f.alias("format"))
    scores = F.transform(F.filter(F.array_distinct(named("format")), lambda f: f != "UNKNOWN"), score)
    return F.struct(
        F.get(r, 0)["value"].alias("value"), F.coalesce(F.array_max(scores)["format"], F.lit("UNKNOWN")).alias("format"), F.get(r, 0)["first"].alias("first_ord"),
        F.array_sort(F.array_distinct(named("engine"))).alias("engines"), F.array_sort(F.array_distinct(F.filter(named("variant"), lambda v: v != ""))).alias("variants"),
        F.aggregate(r, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"]).alias("observations"), F.array_min(named("fastest")).alias("fastest_ms"),
        F.array_max(named("own")).alias("engine_score"), F.array_distinct(named("format")).alias("formats"),
    )


def consistency(n: Column) -> Column:
    """How surely repeated sightings are no accident: 0 for one, 1 from eight on, to three digits between."""
    return F.when(n <= 1, 0.0).when(n >= 8, 1.0).otherwise(fixed(F.log2(n.cast("double")) / 3))


def _valued(key: Column, values: dict, otherwise: float) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def score(agreement: Column, observations: Column, structural: Column, form: Column, own: Column) -> Column:
    """Confidence in thousandths; own is an engine's score or null, which counts as 0."""
    w = dims.WEIGHTS
    x = _valued(agreement, {1: dims.AGREEMENT[1], 2: dims.AGREEMENT[2]}, dims.AGREEMENT[3]) * w["agreement"] + consistency(observations) * w["consistency"] + _valued(structural, dims.STRUCTURAL, 0.0) * w["structural"]
    x = x + _valued(form, dims.FORMAT_PRIOR, 0.0) * w["format_prior"] + F.coalesce(own, F.lit(0.0)) * w["engine"]
    return F.round(fixed(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))) * 1000).cast("int")


def with_confidence(g: DataFrame) -> DataFrame:
    """Adds structural kind, confidence (thousandths), its source and the retail, origin and URL marks."""
    valid, gtin = fmt.payload_valid(F.col("value"), F.col("format")), fmt.payload_kind(F.col("format")) == "gtin"
    g = g.withColumn("structural", F.concat(F.when(gtin, "gtin").otherwise("other"), F.when(valid, "_valid").otherwise("_invalid")))
    return g.withColumns({
        "confidence": score(F.col("agreement"), F.col("observations"), F.col("structural"), F.col("format"), F.col("engine_score")),
        "confidence_source": F.when(F.col("engine_score").isNull(), "derived").otherwise("engine"),
        "is_retail": F.col("format").isin(dims.RETAIL_FORMATS), "is_indian": fmt.is_indian_gs1(F.col("value")), "is_url": fmt.is_url_payload(F.col("value"), F.col("format")),
    })


def rank_score() -> Column:
    return F.col("is_retail").cast("int") * 10000 + F.col("confidence") + F.least("observations", F.lit(12)).cast("int") * 10 - F.col("is_url").cast("int") * 400


def ranked(obs: DataFrame) -> DataFrame:
    """All candidates with their position in the image; ties keep the order in which they were first seen."""
    w = Window.partitionBy("image_id").orderBy(F.col("rank_score").desc(), "first_ord", "payload")
    return with_confidence(groups(obs)).withColumn("rank_score", rank_score()).withColumn("position", F.row_number().over(w))


def kept(r: DataFrame, most: int = dims.MAX_RESULTS) -> DataFrame:
    """Candidates of at least 0.6 times the leader's confidence, at most `most` an image."""
    w = Window.partitionBy("image_id").orderBy("position")
    strong = r.withColumn("_lead", F.first("confidence").over(w)).filter(F.col("confidence") / 1000.0 >= F.col("_lead") / 1000.0 * dims.RELATIVE_CUTOFF)
    return strong.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most).drop("_lead")


def primary(k: DataFrame) -> DataFrame:
    """The one candidate to look up: first retail code that is no URL, else Code 128, else not 2-D, else first."""
    tier = F.when(F.col("is_retail") & ~F.col("is_url"), 0).when(F.col("format") == "Code 128", 1).when(~F.col("format").isin(dims.TWO_D_FORMATS), 2).otherwise(3)
    best = F.struct(tier.alias("tier"), "position")
    return k.groupBy("image_id").agg(F.min_by(F.struct("value", "format", "confidence", "agreement"), best).alias("p"), F.min(best)["tier"].alias("tier")).select("image_id", "p.*", "tier")


def stops(obs: DataFrame, confidence: float = dims.STOP_CONFIDENCE, agreement: int = dims.STOP_AGREEMENT) -> DataFrame:
    """image_id, steps, reason: after how many observations the sweep of an image may stop.

    Checks of payloads and weights are expressions; what depends on all observations before, the state of every
    candidate, is kept up to date by a fold over an image's sweep, which has at most variants times engines
    attempts. Sweeps are sorted within partitions and read batch by batch.
    """
    spark = obs.sparkSession
    ship(spark)
    f, v = F.col("format"), F.col("value")
    ok = {n: F.coalesce(fmt.payload_valid(v, F.lit(n)), F.lit(False)) for n in dims.FORMATS}
    rows = obs.select(
        "image_id", "ord", "value", "engine", "format", F.trim("value").alias("payload"), f.isin(dims.FUSION_2D_FORMATS).alias("flat"), F.coalesce(_weight(), F.lit(0.0)).alias("w"),
        F.array(*ok.values()).alias("ok"), fmt.is_url_payload(v, F.lit("QR Code")).alias("url"),
    )
    sorted_rows = rows.repartition("image_id").sortWithinPartitions("image_id", "ord", "value", "engine")
    kind = obs.schema["image_id"]
    schema = T.StructType([kind, T.StructField("steps", T.IntegerType()), T.StructField("reason", T.StringType())])
    return sorted_rows.mapInArrow(Sweeps(confidence, agreement, schema.names).run, schema)


class Sweeps:
    """Folds sorted observations; holds the open image's candidates."""

    def __init__(self, confidence: float, agreement: int, names: list[str]):
        self.least, self.agreement, self.names = round(confidence * 1000), agreement, names
        rows = {(a, n, s, f): c for a, n, s, f, c in dims.confidence_rows()}
        self.table = rows

    def run(self, batches):
        import pyarrow as pa

        image, found, steps, reason, none = None, {}, 0, None, True
        for b in batches:
            kind, out = b.column(0).type, []
            for i, value, engine, form, payload, flat, w, ok, url in zip(*(b.column(c).to_pylist() for c in ("image_id", "value", "engine", "format", "payload", "flat", "w", "ok", "url"))):
                if none or i != image:
                    if not none:
                        out.append((image, steps, reason or "variant_budget_exhausted"))
                    image, found, steps, reason, none = i, {}, 0, None, False
                if reason:
                    continue
                steps += 1
                if payload:
                    one = found.setdefault((flat, payload), {"order": len(found), "ok": dict(zip(dims.FORMATS, ok)), "url": url, "engines": set(), "n": 0, "w": {}})
                    one["engines"].add(engine)
                    one["n"] += 1
                    if form != "UNKNOWN":
                        one["w"][form] = one["w"].get(form, 0.0) + w
                    one["now"] = self.candidate(one)
                    reason = self.verdict([c["now"] for c in found.values()])
            if out:
                yield self.batch(out, kind, pa)
        if not none:
            yield self.batch([(image, steps, reason or "variant_budget_exhausted")], kind, pa)

    def batch(self, rows, kind, pa):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=self.names)

    def candidate(self, c: dict) -> tuple:
        """(rank, first seen, format, confidence, agreement, is a URL) of a candidate's state."""
        form = max(c["w"], key=lambda f: c["w"][f] + {"EAN-13": 0.1, "EAN-8": 0.05}.get(f, 0.0), default="UNKNOWN")
        retail, agreed = form in dims.RETAIL_FORMATS, len(c["engines"])
        kind = ("gtin" if retail else "other") + ("_valid" if c["ok"][form] else "_invalid")
        sure, url = self.table[min(agreed, 3), min(c["n"], 8), kind, form], form == "QR Code" and c["url"]
        return -(10000 * retail + sure + 10 * min(c["n"], 12) - 400 * url), c["order"], form, sure, agreed, url

    def verdict(self, all_: list[tuple]) -> str | None:
        """Why the sweep may stop now, by its primary candidate; None if it may not."""
        all_ = sorted(all_)
        kept = [c for c in all_ if c[3] / 1000 >= all_[0][3] / 1000 * dims.RELATIVE_CUTOFF][: dims.MAX_RESULTS]
        best = min(kept, key=lambda c: 0 if c[2] in dims.RETAIL_FORMATS and not c[5] else 1 if c[2] == "Code 128" else 2 if c[2] not in dims.TWO_D_FORMATS else 3)
        if best[3] >= self.least:
            return "confidence_target_reached"
        return "multi_engine_agreement" if best[4] >= self.agreement and best[2] in dims.RETAIL_FORMATS else None


def engine_attempts(obs: DataFrame) -> DataFrame:
    """Of every engine and image: variants tried, detections and milliseconds to two digits."""
    return obs.groupBy("image_id", "engine").agg(F.count_distinct("variant").alias("variants_tried"), F.count("*").alias("detections"), F.round(F.sum(F.col("decode_ms").cast("double")), 2).alias("total_ms"))


def engine_scores(obs: DataFrame) -> DataFrame:
    """image_id, payload, scores: every engine that saw a candidate with its own best score, null where it gives none."""
    per = _paid(obs).groupBy("image_id", "payload", "engine").agg(F.max("engine_confidence").alias("confidence"))
    return per.groupBy("image_id", "payload").agg(F.array_sort(F.collect_list(F.struct("engine", "confidence"))).alias("scores"))


def image_class(values: Column, expected: Column) -> Column:
    """miss without values; correct if any of them is the expected one, or none is expected; else incorrect."""
    want = F.trim(F.coalesce(expected, F.lit("")))
    return F.when(values.isNull() | (F.size(values) == 0), "miss").when((want == "") | F.array_contains(values, want), "correct").otherwise("incorrect")


def detection_states(images: DataFrame, primaries: DataFrame, least: int = 500) -> DataFrame:
    """state, value, usable, selection and key_kind of images (image_id, engines: how many looked).

    Only a candidate of at least `least` thousandths counts as detected; only a retail code can be looked up.
    """
    j = images.join(primaries, "image_id", "left")
    tried, found = F.col("engines") > 0, F.col("value").isNotNull()
    state = F.when(~tried, "not_attempted").when(~found, "no_barcode").when(F.coalesce(F.col("confidence") < least, F.lit(True)), "low_confidence").otherwise("detected")
    url = fmt.is_url_payload(F.col("value"), F.col("format"))
    names = F.array(*[F.lit(n) for n in ("retail_gtin", "code_128", "other_1d", "fallback_first")])
    kind = F.when(found, F.when(url, "url").when(F.col("format").isin(dims.RETAIL_FORMATS), "gtin").otherwise("other"))
    j = j.select("image_id", state.alias("state"), "value", F.when(tried, F.get(names, F.col("tier"))).alias("selection"), F.when(tried, kind).alias("key_kind"))
    seen = F.col("state") == "detected"
    return j.select("image_id", "state", F.when(seen, F.col("value")).alias("value"), (seen & (F.col("key_kind") == "gtin")).alias("usable"), "selection", "key_kind").fillna(False, ["usable"])


def accuracy(primaries: DataFrame, truth: DataFrame) -> DataFrame:
    """How often the primary candidate is the expected payload; truth: image_id, expected."""
    j = truth.join(primaries, "image_id", "left")
    return j.agg(F.count("*").alias("images"), F.count_if(F.col("value") == F.col("expected")).alias("correct"), F.count_if(F.col("value").isNull()).alias("missed"))


def without_2d(obs: DataFrame, side: str = "server") -> DataFrame:
    """Observations that are no two-dimensional codes; the browser's rule keeps PDF417, the server's does not."""
    return obs.filter(~F.col("format").isin({"server": dims.TWO_D_FORMATS, "browser": dims.FUSION_2D_FORMATS}[side]))


def places(obs: DataFrame) -> DataFrame:
    """image_id, class, payload, points and box of each candidate: of its first observation that has points; null if none has."""
    o = _paid(obs).withColumn("class", F.when(F.col("format").isin(dims.FUSION_2D_FORMATS), "2D").otherwise("1D"))
    first = F.min_by("points", F.when(F.size("points") > 0, F.col("ord")))
    g = o.groupBy("image_id", "class", "payload").agg(first.alias("points"))
    return g.withColumn("box", fmt.bounding_box(F.col("points")))


def pick_agreement(k: DataFrame) -> DataFrame:
    """image_id, picked, served, agrees: the candidate that a client looks up (`primary`) and the one that the service ranks first."""
    served = k.groupBy("image_id").agg(F.min_by("value", "position").alias("served"))
    return primary(k).select("image_id", F.col("value").alias("picked")).join(served, "image_id").withColumn("agrees", F.col("picked") == F.col("served"))
