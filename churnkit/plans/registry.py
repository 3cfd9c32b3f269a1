"""Query registry: one callable ``(spark, sf_dir) -> DataFrame`` per operator key.

Double columns of compared results are rounded portably (6 dp unless the
reference itself serves fewer digits) so that the result does not depend on
the summation order of an engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.operators import prep
from churnkit.operators import segments as seg
from churnkit.functions.columns import fixed
from churnkit.plans.context import Fixture, round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def fx(spark: SparkSession, sf_dir: str) -> Fixture:
    return Fixture(spark, sf_dir)


# ------------------------------------------------------------ 2.3 treatment
@query("scan_subscriber")
def q_scan_subscriber(spark, sf_dir):
    return round_doubles(fx(spark, sf_dir).raw)


@query("clean_target")
def q_clean_target(spark, sf_dir):
    f = fx(spark, sf_dir)
    return prep.clean_target(f.raw, f.spec)


@query("clean_yes_no")
def q_clean_yes_no(spark, sf_dir):
    f = fx(spark, sf_dir)
    return prep.clean_yes_no(f.raw, f.spec)


@query("clean_known_flag")
def q_clean_known_flag(spark, sf_dir):
    f = fx(spark, sf_dir)
    return prep.clean_known_flag(f.raw, f.spec)


@query("encode_onehot")
def q_encode_onehot(spark, sf_dir):
    f = fx(spark, sf_dir)
    return prep.encode_onehot(f.raw, prep.fit_levels(f.raw, f.spec), f.spec)


@query("clean_text_number")
def q_clean_text_number(spark, sf_dir):
    f = fx(spark, sf_dir)
    return prep.clean_with_median(f.raw, f.spec, f.params.medians, list(f.spec.text_number), True)


@query("clean_zero_sentinel")
def q_clean_zero_sentinel(spark, sf_dir):
    f = fx(spark, sf_dir)
    return prep.clean_with_median(f.raw, f.spec, f.params.medians, list(f.spec.zero_sentinel), True)


@query("clean_negative_sentinel")
def q_clean_negative_sentinel(spark, sf_dir):
    f = fx(spark, sf_dir)
    return prep.clean_with_median(f.raw, f.spec, f.params.medians,
                                  list(f.spec.negative_sentinel), False)


@query("flag_all_null_block")
def q_flag_all_null_block(spark, sf_dir):
    f = fx(spark, sf_dir)
    return prep.flag_all_null_block(f.raw, f.spec)


@query("impute_median")
def q_impute_median(spark, sf_dir):
    f = fx(spark, sf_dir)
    cols = list(f.spec.billing) + list(f.spec.residual)
    return round_doubles(prep.clean_with_median(f.raw, f.spec, f.params.medians, cols, False))


@query("encode_ordinal")
def q_encode_ordinal(spark, sf_dir):
    f = fx(spark, sf_dir)
    return prep.encode_ordinal(f.raw, f.spec)


@query("encode_frequency")
def q_encode_frequency(spark, sf_dir):
    f = fx(spark, sf_dir)
    return prep.encode_frequency(f.raw, f.params)


@query("treat_all")
def q_treat_all(spark, sf_dir):
    return round_doubles(fx(spark, sf_dir).treated)


@query("fit_params")
def q_fit_params(spark, sf_dir):
    f = fx(spark, sf_dir)
    med = f.params.medians_df(spark).select(
        F.lit("median").alias("tipo"), F.col("coluna").alias("chave"), F.col("mediana").alias("valor"))
    area = f.params.area.select(F.lit("area_freq").alias("tipo"), F.col("area").alias("chave"),
                                F.col("freq").alias("valor"))
    return round_doubles(med.unionByName(area), 9)


@query("apply_params")
def q_apply_params(spark, sf_dir):
    """C14: parameters learned on the train side of the stratified split and
    replayed on the test side (unseen areas -> 0.0, unseen levels -> zeros)."""
    from churnkit.operators import split as sp
    f = fx(spark, sf_dir)
    split = sp.split_stratified(f.raw.select("CustomerID", prep.flag_equals_col(f.spec)), "CustomerID", "Churn")
    params = sp.fit_on_train(f.raw, split, lambda train: prep.fit(train, f.spec))
    return round_doubles(prep.apply(sp.split_align(f.raw, split, sp.TEST), params))


@query("treatment_log")
def q_treatment_log(spark, sf_dir):
    f = fx(spark, sf_dir)
    return round_doubles(prep.treatment_log(f.raw, f.params), 6)


@query("audit_treated")
def q_audit_treated(spark, sf_dir):
    f = fx(spark, sf_dir)
    return round_doubles(prep.audit_treated(f.raw, f.treated, f.spec))


# ------------------------------------------------------------- 2.4 features
@query("derive_features")
def q_derive_features(spark, sf_dir):
    return round_doubles(fx(spark, sf_dir).features)


# ------------------------------------------------------------- 2.8 segments
@query("segment_cuts")
def q_segment_cuts(spark, sf_dir):
    f = fx(spark, sf_dir)
    return round_doubles(seg.cuts_frame(spark, f.cuts), 9)


@query("segment_assign")
def q_segment_assign(spark, sf_dir):
    return fx(spark, sf_dir).segments


@query("segment_sizes")
def q_segment_sizes(spark, sf_dir):
    return seg.segment_sizes(fx(spark, sf_dir).segments)


# ------------------------------------------------------------- 2.2 profile
from churnkit.operators import profile as prof  # noqa: E402

FIXTURE_SENTINELS = [("HandsetPrice", "Unknown"), ("MaritalStatus", "Unknown"),
                     ("Homeownership", "Unknown"), ("AgeHH1", 0)]


@query("profile_shape")
def q_profile_shape(spark, sf_dir):
    return prof.profile_shape(fx(spark, sf_dir).raw)


@query("profile_target")
def q_profile_target(spark, sf_dir):
    return prof.profile_target(fx(spark, sf_dir).raw)


@query("profile_nulls")
def q_profile_nulls(spark, sf_dir):
    return prof.profile_nulls(fx(spark, sf_dir).raw)


@query("profile_disguised")
def q_profile_disguised(spark, sf_dir):
    return prof.profile_disguised(fx(spark, sf_dir).raw)


@query("profile_sentinel_share")
def q_profile_sentinel_share(spark, sf_dir):
    return prof.profile_sentinel_share(fx(spark, sf_dir).raw, FIXTURE_SENTINELS)


@query("profile_cardinality")
def q_profile_cardinality(spark, sf_dir):
    return prof.profile_cardinality(fx(spark, sf_dir).raw)


@query("profile_domains")
def q_profile_domains(spark, sf_dir):
    return prof.profile_domains(fx(spark, sf_dir).raw)


@query("profile_describe")
def q_profile_describe(spark, sf_dir):
    return round_doubles(prof.profile_describe(fx(spark, sf_dir).raw), 6)


@query("profile_dup_keys")
def q_profile_dup_keys(spark, sf_dir):
    return prof.profile_dup_keys(fx(spark, sf_dir).raw)


@query("profile_dup_rows")
def q_profile_dup_rows(spark, sf_dir):
    return prof.profile_dup_rows(fx(spark, sf_dir).raw)


@query("profile_negatives")
def q_profile_negatives(spark, sf_dir):
    return prof.profile_negatives(fx(spark, sf_dir).raw)


@query("profile_top_values")
def q_profile_top_values(spark, sf_dir):
    return prof.profile_top_values(fx(spark, sf_dir).raw, "HandsetPrice")


@query("profile_rate_by_quartile")
def q_profile_rate_by_quartile(spark, sf_dir):
    return round_doubles(prof.profile_rate_by_quartile(fx(spark, sf_dir).raw), 6)


# ------------------------------------------------------------- 2.6 curves
from churnkit.operators import curves as cv  # noqa: E402

COMPARED = [("max_f2_025", 0.25), ("recall_90_031", 0.31)]


def _sc(spark, sf_dir):
    return cv.score_counts(fx(spark, sf_dir).scores)


@query("score_counts")
def q_score_counts(spark, sf_dir):
    return _sc(spark, sf_dir)


@query("confusion_at")
def q_confusion_at(spark, sf_dir):
    return cv.confusion_at(_sc(spark, sf_dir), cv.OFFICIAL_THRESHOLD)


@query("metrics_at")
def q_metrics_at(spark, sf_dir):
    return cv.metrics_at(_sc(spark, sf_dir), 0.25)


@query("sweep_f2")
def q_sweep_f2(spark, sf_dir):
    return cv.sweep_f2(_sc(spark, sf_dir))


@query("threshold_f2")
def q_threshold_f2(spark, sf_dir):
    return cv.threshold_f2(_sc(spark, sf_dir))


@query("sweep_recall")
def q_sweep_recall(spark, sf_dir):
    return cv.sweep_recall(_sc(spark, sf_dir))


@query("threshold_recall")
def q_threshold_recall(spark, sf_dir):
    return cv.threshold_recall(_sc(spark, sf_dir))


@query("roc_curve")
def q_roc_curve(spark, sf_dir):
    return round_doubles(cv.roc_curve(_sc(spark, sf_dir)), 6)


@query("roc_200")
def q_roc_200(spark, sf_dir):
    return cv.roc_reduced(_sc(spark, sf_dir))


@query("auc_roc")
def q_auc_roc(spark, sf_dir):
    return round_doubles(cv.auc_roc(_sc(spark, sf_dir)), 9)


@query("average_precision")
def q_average_precision(spark, sf_dir):
    return round_doubles(cv.average_precision(_sc(spark, sf_dir)), 9)


@query("score_histogram")
def q_score_histogram(spark, sf_dir):
    return cv.score_histogram(_sc(spark, sf_dir))


@query("compare_models")
def q_compare_models(spark, sf_dir):
    return cv.compare_thresholds(_sc(spark, sf_dir), COMPARED)


@query("compare_two_models")
def q_compare_two_models(spark, sf_dir):
    """E9 on two score tables: the first at .25, the second at the threshold its own recall rule gives."""
    from churnkit.sources import fixtures
    f = fx(spark, sf_dir)
    new = cv.score_counts(fixtures.challenger_scores(spark, sf_dir, f.raw))
    t = cv.threshold_recall(new).first()["threshold"]
    return cv.compare_models([("anterior", cv.score_counts(f.scores), 0.25), ("melhorado", new, t)])


def _change_sets(scores):
    """Three change sets of the score table, and the table before them: scores that move, customers that
    leave, then customers that come and more that move."""
    k = F.col("CustomerID")
    held_out = k % 13 == 5
    bp = cv.to_bp("prob_churn")

    def moved(df, to):
        return df.select("CustomerID", (to.cast("double") / F.lit(10000.0)).alias("prob_churn"), "churn_real")

    start = scores.where(~held_out)
    one = moved(start.where(k % 5 == 1), (bp * 3 + 17) % 10001)
    two = start.where(k % 11 == 2).select("CustomerID", F.lit(None).cast("double").alias("prob_churn"), "churn_real")
    come = scores.where(held_out)
    three = moved(start.where((k % 7 == 3) & (k % 11 != 2) & (k % 5 != 1)), (bp + 2500) % 10001).unionByName(come)
    return start, [one, two, three]


@query("score_counts_delta")
def q_score_counts_delta(spark, sf_dir):
    """E1-E8's counts after three change sets, kept by signed deltas: no customer but the changed ones is read again."""
    from churnkit.operators import deltas as dl
    state, sets = _change_sets(fx(spark, sf_dir).scores.select("CustomerID", "prob_churn", "churn_real"))
    counts = cv.score_counts(state)
    for new in sets:
        counts = dl.apply_deltas(counts, dl.score_deltas(dl.changes(state, new)))
        state = dl.next_state(state, new)
    return counts


@query("curves_delta")
def q_curves_delta(spark, sf_dir):
    """E6 and E7 of the counts that the deltas leave."""
    sc = q_score_counts_delta(spark, sf_dir)
    return cv.auc_roc(sc).select(fixed("auc_roc", 9).alias("auc_roc")).join(
        F.broadcast(cv.average_precision(sc).select(fixed("average_precision", 9).alias("average_precision"))))  # one row each


@query("bundle_meta")
def q_bundle_meta(spark, sf_dir):
    f = fx(spark, sf_dir)
    return cv.bundle_meta(f.scores, cv.score_counts(f.scores))


@query("risk_ranking")
def q_risk_ranking(spark, sf_dir):
    return cv.risk_ranking(fx(spark, sf_dir).scores)


# ---------------------------------------------------- 2.8 policy, 2.9 serving
from churnkit.operators import explain as ex  # noqa: E402
from churnkit.operators import policy as pol  # noqa: E402
from churnkit.operators import serving as sv  # noqa: E402
from churnkit.session import scratch_path  # noqa: E402
from churnkit.operators import split as sp  # noqa: E402
from churnkit.plans.context import Chain  # noqa: E402


def ch(spark, sf_dir) -> Chain:
    return Chain(spark, sf_dir)


@query("offer_log")
def q_offer_log(spark, sf_dir):
    return ch(spark, sf_dir).offers


@query("action_dim")
def q_action_dim(spark, sf_dir):
    return pol.with_actions(ch(spark, sf_dir).offers)


@query("policy_counts")
def q_policy_counts(spark, sf_dir):
    return ch(spark, sf_dir).counts


@query("policy_order")
def q_policy_order(spark, sf_dir):
    return ch(spark, sf_dir).order


@query("policy_best")
def q_policy_best(spark, sf_dir):
    return ch(spark, sf_dir).best


@query("recommend")
def q_recommend(spark, sf_dir):
    return ch(spark, sf_dir).reco


@query("learning_curve")
def q_learning_curve(spark, sf_dir):
    c = ch(spark, sf_dir)
    return pol.learning_curve(c.offers, c.counts)


@query("regret_curve")
def q_regret_curve(spark, sf_dir):
    c = ch(spark, sf_dir)
    return pol.learning_curve(c.offers, c.counts).select("rodada", "regret_medio")


@query("posterior_mean")
def q_posterior_mean(spark, sf_dir):
    return pol.posterior_mean(ch(spark, sf_dir).counts)


@query("thompson_assign")
def q_thompson_assign(spark, sf_dir):
    c = ch(spark, sf_dir)
    return pol.thompson_assign(c.segments, c.counts)


@query("client_detail")
def q_client_detail(spark, sf_dir):
    return ch(spark, sf_dir).detail


@query("retention_queue")
def q_retention_queue(spark, sf_dir):
    return sv.retention_queue(ch(spark, sf_dir).detail)


@query("queue_search")
def q_queue_search(spark, sf_dir):
    return sv.queue_search(sv.retention_queue(ch(spark, sf_dir).detail), " 12 ")


@query("client_lookup")
def q_client_lookup(spark, sf_dir):
    c = ch(spark, sf_dir)
    first = c.top(1).select("CustomerID").first()[0]
    head = c.top(sv.DETAIL_TOP).where(F.col("CustomerID") == first)  # one customer from here on
    return sv.client_lookup(c.detail_of(head), first)


@query("client_lookup_bucketed")
def q_client_lookup_bucketed(spark, sf_dir):
    """G4 over the whole ranking, written in sorted buckets: one customer reads one bucket."""
    from churnkit.sources import lookup as lk
    c = ch(spark, sf_dir)
    name = lk.write_lookup(c.ranking, "CustomerID", buckets=16)
    return lk.lookup(spark, name, "CustomerID", c.top(1).select("CustomerID").first()[0])


@query("client_search")
def q_client_search(spark, sf_dir):
    """G3 over all ranked customers, by the posting list of the digits in their ids."""
    from churnkit.sources import lookup as lk
    ranking = ch(spark, sf_dir).ranking
    name = lk.write_postings(ranking, "CustomerID", buckets=16)
    return ranking.join(lk.ids_containing(spark, name, "CustomerID", " 112 "), "CustomerID", "left_semi")


@query("offer_outcome")
def q_offer_outcome(spark, sf_dir):
    c = ch(spark, sf_dir)
    return sv.offer_outcome(c.offers, c.scores)


@query("next_best_offer")
def q_next_best_offer(spark, sf_dir):
    c = ch(spark, sf_dir)
    return sv.next_best_offer(c.segments, c.offer_events, c.order)


@query("next_offer_upsert")
def q_next_offer_upsert(spark, sf_dir):
    """G6 kept as a bucketed table: created from the segments, then three increments of the log upserted
    (one of them delivered twice)."""
    from churnkit.sources.upsert import BucketTable
    c = ch(spark, sf_dir)
    table = BucketTable(spark, scratch_path(spark, "next-offers"), sv.OFFER_STATE, "CustomerID", buckets=16)
    table.create(sv.never_contacted(c.segments))
    log = c.offer_events.select("event_id", "CustomerID", "acao", "aceitou").checkpoint(eager=True)  # as the increments would arrive
    for k in (0, 1, 2, 1):
        table.upsert(sv.offer_state(log.where(F.col("event_id") % 3 == k)), sv.merge_offer_state, batch=f"parte-{k}")
    return sv.next_offer_of(table.read(), c.order)


CAMPAIGN_TOP, CAMPAIGN_LTV = 500, 600.0  # the reference's worked example


@query("campaign_total")
def q_campaign_total(spark, sf_dir):
    return sv.campaign_total(ch(spark, sf_dir).campaign_input(CAMPAIGN_TOP), CAMPAIGN_TOP, CAMPAIGN_LTV)


@query("campaign_by_segment")
def q_campaign_by_segment(spark, sf_dir):
    return sv.campaign_by_segment(ch(spark, sf_dir).campaign_input(CAMPAIGN_TOP), CAMPAIGN_TOP, CAMPAIGN_LTV)


@query("ranking_preview")
def q_ranking_preview(spark, sf_dir):
    return sv.ranking_preview(ch(spark, sf_dir).top(sv.PREVIEW_ROWS))


# ------------------------------------------------------------ 2.7 explain
@query("attribution_linear")
def q_attribution_linear(spark, sf_dir):
    return ex.attribution_linear(fx(spark, sf_dir).features, ex.FIXTURE_COEFS, ex.FIXTURE_INTERCEPT)


def _attributions(spark, sf_dir):
    return ex.attribution_linear(fx(spark, sf_dir).features, ex.FIXTURE_COEFS, ex.FIXTURE_INTERCEPT, rounded=False)


@query("attribution_top5")
def q_attribution_top5(spark, sf_dir):
    return ex.top_factors_in_row(fx(spark, sf_dir).features, ex.FIXTURE_COEFS, ex.FIXTURE_INTERCEPT).drop("maior")


@query("attribution_global")
def q_attribution_global(spark, sf_dir):
    return ex.attribution_global(_attributions(spark, sf_dir))


@query("factor_scale_global")
def q_factor_scale_global(spark, sf_dir):
    return ex.global_scale(ex.attribution_global(_attributions(spark, sf_dir)))


@query("factor_labels")
def q_factor_labels(spark, sf_dir):
    return ch(spark, sf_dir).factors.select("CustomerID", "ordem", "variavel", "rotulo")


@query("factor_scale")
def q_factor_scale(spark, sf_dir):
    return sv.factor_scale(ch(spark, sf_dir).factors)


# ---------------------------------------------------------- 2.5 split M1-M5
@query("split_stratified")
def q_split_stratified(spark, sf_dir):
    return ch(spark, sf_dir).split


@query("split_align")
def q_split_align(spark, sf_dir):
    c = ch(spark, sf_dir)
    return round_doubles(sp.split_align(c.features, c.split))


@query("folds_stratified")
def q_folds_stratified(spark, sf_dir):
    return sp.folds_stratified(ch(spark, sf_dir).split, 5)


@query("class_weights")
def q_class_weights(spark, sf_dir):
    c = ch(spark, sf_dir)
    return sp.class_weights(sp.split_align(c.treated, c.split, sp.TRAIN))


@query("standardised")
def q_standardised(spark, sf_dir):
    """M5 applied: every customer's feature columns by the statistics of the train rows."""
    c = ch(spark, sf_dir)
    cols = [x for x in c.features.columns if x != "CustomerID"]
    stats = sp.standardise_stats(sp.split_align(c.features, c.split, sp.TRAIN), cols)
    return round_doubles(sp.standardise(c.features, stats, cols), 6)


@query("standardise")
def q_standardise(spark, sf_dir):
    c = ch(spark, sf_dir)
    train = sp.split_align(c.features, c.split, sp.TRAIN)
    cols = [x for x in c.features.columns if x != "CustomerID"]
    return round_doubles(sp.standardise_stats(train, cols), 6)


# ------------------------------------------------------ 2.1 sources / sinks
from churnkit.sources import io as sio  # noqa: E402


@query("scan_raw")
def q_scan_raw(spark, sf_dir):
    """The raw table written as CSV and read back with schema + null tokens."""
    raw = fx(spark, sf_dir).raw
    path = sio.write_csv(raw, scratch_path(spark, "raw-csv"))
    return round_doubles(sio.read_raw(spark, path, sio.raw_schema(raw.columns)))


@query("sink_treated")
def q_sink_treated(spark, sf_dir):
    """S5 + S2: treated table to parquet and back."""
    path = sio.write_parquet(fx(spark, sf_dir).treated, scratch_path(spark, "treated"))
    return round_doubles(sio.read_parquet(spark, path))


@query("sink_ranking")
def q_sink_ranking(spark, sf_dir):
    """Ranked scores to parquet and back."""
    path = sio.write_parquet(ch(spark, sf_dir).ranking, scratch_path(spark, "ranking"))
    return sio.read_parquet(spark, path, sio.SCORE_SCHEMA)


@query("scan_scores")
def q_scan_scores(spark, sf_dir):
    """S3: ranked scores as CSV with header, read with the score schema."""
    path = sio.write_csv(ch(spark, sf_dir).ranking.select(*sio.SCORE_SCHEMA.names),
                         scratch_path(spark, "scores-csv"))
    return sio.read_scores_csv(spark, path)


@query("sink_params")
def q_sink_params(spark, sf_dir):
    """Learned parameters as JSON lines and back."""
    params = q_fit_params(spark, sf_dir)
    path = sio.write_json(params, scratch_path(spark, "params"))
    return spark.read.schema("tipo string, chave string, valor double").json(path)


@query("scan_policy_json")
def q_scan_policy_json(spark, sf_dir):
    """Nested policy documents written as JSON and exploded back."""
    path = sio.write_json(sio.nested_policy(ch(spark, sf_dir).order), scratch_path(spark, "policy-json"))
    return sio.read_policy_json(spark, path)


@query("sink_nested_json")
def q_sink_nested_json(spark, sf_dir):
    """Nested attribution documents (one per customer) and back."""
    docs = ex.factor_documents(fx(spark, sf_dir).features, ex.FIXTURE_COEFS, ex.FIXTURE_INTERCEPT)
    path = sio.write_json(docs, scratch_path(spark, "attr-json"))
    return sio.read_attributions_json(spark, path)


@query("threshold_record")
def q_threshold_record(spark, sf_dir):
    """Chosen threshold (max threshold with recall >= .90) as a one-row record."""
    from churnkit.operators import curves as cv
    t = cv.threshold_recall(_sc(spark, sf_dir)).first()["threshold"]
    rec = sio.threshold_record(spark, t, "max precisao com recall OOF >= 0.9", True)
    path = sio.write_json(rec, scratch_path(spark, "threshold"))
    return spark.read.schema(rec.schema).json(path).select("threshold", "criterio", "usa_features_derivadas")


# ------------------------------------------------------------ 2.8 R13 stream
@query("policy_stream")
def q_policy_stream(spark, sf_dir):
    """Counters from a Structured Streaming run over the offer log; equal to R5."""
    from churnkit.streaming.policy_stream import read_counters, run_policy_stream
    c = ch(spark, sf_dir)
    log_dir = scratch_path(spark, "offer-log")
    c.offer_events.select("CustomerID", "segmento", "acao", "aceitou").write.mode("overwrite").parquet(log_dir)
    out_dir, ck = scratch_path(spark, "policy-out"), scratch_path(spark, "policy-ck")
    run_policy_stream(spark, log_dir, out_dir, ck)
    counts = read_counters(spark, out_dir)
    grid = pol.policy_grid(spark)
    from churnkit.functions.columns import fixed, safe_div
    return (grid.join(F.broadcast(counts), ["segmento", "acao"], "left")
                .select("segmento", "acao",
                        F.coalesce("tentativas", F.lit(0)).cast("long").alias("tentativas"),
                        F.coalesce("aceites", F.lit(0)).cast("long").alias("aceites"),
                        fixed(safe_div("aceites", "tentativas"), 4).alias("taxa_estimada"), "posicao"))


def _policy_state(spark, sf_dir) -> str:
    """The offer log delivered in four parts, the second one late and the third one twice, through the keyed stream, a
    micro-batch per delivery; its output folder."""
    from churnkit.streaming import policy_state as ps
    from churnkit.functions.ordering import global_index
    c = ch(spark, sf_dir)
    log = global_index(c.offer_events, [F.col("ts").asc(), F.col("event_id").asc()], "rodada")
    log = log.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "rodada", "segmento", "acao", "aceitou").checkpoint(eager=True)
    quarter = F.pmod(F.floor((F.col("rodada") - 1) / 100), F.lit(4))
    log_dir = scratch_path(spark, "offers-in")
    files = ps.deliver(log, [quarter == k for k in (0, 2, 1, 2, 3)], log_dir)
    out_dir = scratch_path(spark, "policy-state")
    # the horizon for late offers is the log's own span here
    ps.run_policy_state(spark, log_dir, out_dir, scratch_path(spark, "policy-state-ck"), watermark="3650 days", files_per_trigger=files)
    return out_dir


@query("policy_state_counts")
def q_policy_state_counts(spark, sf_dir):
    """R13 by keyed state: the counters of R5 from a log that arrives late and twice."""
    from churnkit.streaming import policy_state as ps
    return ps.state_counts(spark, _policy_state(spark, sf_dir))


@query("policy_state_curve")
def q_policy_state_curve(spark, sf_dir):
    """R10 from the blocks that the keyed state holds."""
    from churnkit.streaming import policy_state as ps
    return ps.state_curve(spark, _policy_state(spark, sf_dir))


# -------------------------------------------------- 2.5 modelling (rows-only)
from churnkit.operators import models as md  # noqa: E402
from churnkit.operators import treeshap as ts  # noqa: E402
from churnkit.plans.context import ModelChain  # noqa: E402


def mc(spark, sf_dir) -> ModelChain:
    return ModelChain(spark, sf_dir)


def _scored(model, df):
    return md.score(model, df).select("CustomerID", fixed("prob_churn", 4).alias("prob_churn"), "churn_real")


@query("model_logistic")
def q_model_logistic(spark, sf_dir):
    """M6 at the reference's settings."""
    m = mc(spark, sf_dir)
    tr = m.weighted(m.train, positive_only=False)
    return _scored(md.fitted(md.logistic_factory(m.cols)(tr), tr), m.test)


@query("model_boosted")
def q_model_boosted(spark, sf_dir):
    """M7, full settings."""
    m = mc(spark, sf_dir)
    return _scored(md.fitted(md.boosted_pipeline(m.cols), m.weighted(m.train, positive_only=True)), m.test)


@query("cv_summary")
def q_cv_summary(spark, sf_dir):
    m = mc(spark, sf_dir)
    models = {"logistica": md.logistic_factory(m.cols), "boosted": md.boosted_factory(m.cols)}
    return round_doubles(md.cv_summary(models, m.weighted(m.train, positive_only=False), m.folds_k), 6)


@query("oof_scores")
def q_oof_scores(spark, sf_dir):
    return mc(spark, sf_dir).oof()


@query("random_search")
def q_random_search(spark, sf_dir):
    return mc(spark, sf_dir).search()[1]


@query("ablation")
def q_ablation(spark, sf_dir):
    """Boosted model with and without the derived features (AUC-PR, same folds)."""
    res, keep = mc(spark, sf_dir).ablation()
    return res.withColumn("usa_features", F.lit(int(keep)))


@query("champion")
def q_champion(spark, sf_dir):
    """Incumbent settings vs the best searched candidate by AUC-PR; ties to the challenger."""
    res, win, _ = mc(spark, sf_dir).champion()
    return res.withColumn("vencedor", F.lit(win))


@query("model_threshold")
def q_model_threshold(spark, sf_dir):
    """S10 + E4 of the chain: the threshold that the champion's out-of-fold scores give, with its settings."""
    from churnkit.operators import curves as cv
    m = mc(spark, sf_dir)
    _, win, params = m.champion()
    t = cv.threshold_recall(cv.score_counts(m.oof())).first()["threshold"]
    rec = sio.threshold_record(spark, t, "max precisao com recall OOF >= 0.9", m.ablation()[1], params)
    path = sio.write_json(rec, scratch_path(spark, "model-threshold"))
    return spark.read.schema(rec.schema).json(path)


@query("model_score")
def q_model_score(spark, sf_dir):
    """M13 + M15 + S9: the champion fitted on train with its full settings, saved and
    reloaded, scores the test rows, ranked."""
    from churnkit.operators import curves as cv
    m = mc(spark, sf_dir)
    return cv.risk_ranking(_scored(m.winner(), m.test))


def _saved_nodes(spark, model):
    path = scratch_path(spark, "gbt-model")
    model.stages[-1].write().save(path)
    return spark.read.parquet(f"{path}/data")


@query("importance_gain")
def q_importance_gain(spark, sf_dir):
    """Mean gain per split over the saved node table, top 20."""
    m = mc(spark, sf_dir)
    return md.gain_per_split(_saved_nodes(spark, m.winner()), m.chosen_cols())


@query("importance_normalised")
def q_importance_normalised(spark, sf_dir):
    """Normalised importances of the boosted model, top 20."""
    m = mc(spark, sf_dir)
    return md.importance_table(m.winner(), m.chosen_cols())


@query("attribution_tree")
def q_attribution_tree(spark, sf_dir):
    """X1(b): exact tree attributions of the boosted model on the test rows, every variable of each row, largest first."""
    m = mc(spark, sf_dir)
    model = m.winner()
    nodes = _saved_nodes(spark, model).collect()  # model-sized
    out = ts.tree_attributions(m.test, m.chosen_cols(), nodes, model.stages[-1].treeWeights, top=None)
    return out.select("CustomerID", "ordem", "variavel", fixed("shap", 4).alias("shap"),
                      fixed("valor", 3).alias("valor"), fixed("base", 4).alias("base"))


@query("attribution_global_tree")
def q_attribution_global_tree(spark, sf_dir):
    """X2 on the boosted winner: mean |attribution| over the test rows, the 15 largest, summed as one vector per task."""
    m = mc(spark, sf_dir)
    model = m.winner()
    nodes = _saved_nodes(spark, model).collect()  # model-sized
    out = ts.global_tree_attributions(m.test, m.chosen_cols(), nodes, model.stages[-1].treeWeights)
    return ex.largest_global(out)


@query("bundle_importances")
def q_bundle_importances(spark, sf_dir):
    """S11 with the fitted model: the bundle's importances member (normalised, the 20 largest), written and read back."""
    m = mc(spark, sf_dir)
    path = sio.write_parquet(md.importance_table(m.winner(), m.chosen_cols()), scratch_path(spark, "importances"))
    return sio.read_parquet(spark, path)


@query("bundle_export")
def q_bundle_export(spark, sf_dir):
    """Dashboard members written as parquet tables; manifest of their rows and the sums of their values."""
    from churnkit.plans.bundle import export_bundle
    return export_bundle(ch(spark, sf_dir), scratch_path(spark, "bundle"))


@query("publication_manifest")
def q_publication_manifest(spark, sf_dir):
    """S11 + M12 as versions: the bundle is published with its AUC, then two challengers, one that loses and
    one that wins; the rows that readers resolve and the log's verdict on each version."""
    from churnkit.operators import curves as cv
    from churnkit.sources import publish as pb
    c = ch(spark, sf_dir)
    base = scratch_path(spark, "published")
    sc = _sc(spark, sf_dir)
    auc = cv.auc_roc(sc).first()[0]
    small = {"meta": cv.bundle_meta(c.scores, sc), "roc": cv.roc_reduced(sc), "distribuicao": cv.score_histogram(sc), "politica": c.order}
    pb.publish(spark, base, small, metric=auc)
    pb.publish(spark, base, {"politica": c.order}, metric=1.0 - auc)  # the scores turned round
    pb.publish(spark, base, {**small, "ranking": sv.ranking_preview(c.top(sv.PREVIEW_ROWS))}, metric=auc)  # ties win
    now = max(r["versao"] for r in pb.current(spark, base))
    return pb.commits(spark, base).select("versao", "membro", "linhas", fixed("metrica", 6).alias("metrica"), "promovida",
                                          (F.col("versao") == now).alias("atual"))


def _profile_store(spark, sf_dir):
    """The raw table written in files, profiled in two steps: a first half, then all of it (only the rest is read)."""
    from churnkit.operators.profile_store import ProfileStore
    raw = fx(spark, sf_dir).raw
    first, second = scratch_path(spark, "raw-1"), scratch_path(spark, "raw-2")
    raw.where(F.col("CustomerID") % 2 == 0).repartition(4, "CustomerID").write.parquet(first)
    raw.where(F.col("CustomerID") % 2 == 1).repartition(4, "CustomerID").write.parquet(second)
    store = ProfileStore(spark, scratch_path(spark, "profile"))
    store.add([first])
    store.add([first, second])
    return store


@query("profile_store_columns")
def q_profile_store_columns(spark, sf_dir):
    """P4 + P7 from merged sketches, text columns (few values, so the estimates are exact)."""
    text = [f.name for f in fx(spark, sf_dir).raw.schema.fields if f.dataType.simpleString() == "string"]
    return _profile_store(spark, sf_dir).columns().where(F.col("coluna").isin(text)).select("coluna", "linhas", "nulos", "distintos")


@query("profile_store_top")
def q_profile_store_top(spark, sf_dir):
    """P13 from the merged counts of frequent values."""
    return _profile_store(spark, sf_dir).top_values("HandsetPrice").select("valor", "contagem")
