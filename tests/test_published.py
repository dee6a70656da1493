"""Figures that the studies published, from the figures they were made of."""

import pytest

from tidemark.operators import events, stats

# Of 24 videos the subtitle coverage, the average visual change and the group, in the order published.
VIDEOS = [
    ("616", 0.7174700434700433, 0.341839559545315, "low speech / low visual change"),
    ("625", 0.9856975628478222, 0.13924269970227568, "high speech / low visual change"),
    ("652", 0.9787264556039148, 0.43710869558599613, "high speech / high visual change"),
    ("662", 0.9233606286379102, 0.08670274097009681, "high speech / low visual change"),
    ("688", 0.9958407698998921, 0.3994082537977998, "high speech / high visual change"),
    ("700", 0.7265715521122613, 0.3441897227957442, "low speech / high visual change"),
    ("709", 0.9025518110450758, 0.30183058433882015, "low speech / low visual change"),
    ("714", 0.9512712963104195, 0.45081865150995787, "high speech / high visual change"),
    ("723", 0.9809996296296296, 0.21695482355298776, "high speech / low visual change"),
    ("738", 0.6530493970606704, 0.06328706343594191, "low speech / low visual change"),
    ("750", 0.893547994065841, 0.42535902210577003, "low speech / high visual change"),
    ("756", 0.9376224082851357, 0.3068665325205652, "high speech / low visual change"),
    ("774", 0.8216905532574967, 0.20130349774372647, "low speech / low visual change"),
    ("788", 0.810250268355642, 0.20848863148287441, "low speech / low visual change"),
    ("799", 0.5437807381941475, 0.29251418656604306, "low speech / low visual change"),
    ("807", 0.9875292273822953, 0.5884166311257811, "high speech / high visual change"),
    ("811", 0.8520152913236634, 0.526003911950576, "low speech / high visual change"),
    ("838", 0.9679449205534274, 0.49700331719318763, "high speech / high visual change"),
    ("869", 0.7498746720398091, 0.4321646372774779, "low speech / high visual change"),
    ("878", 0.7356298798798805, 0.4787505320101909, "low speech / high visual change"),
    ("889", 0.6913691441656331, 0.3841763321338719, "low speech / high visual change"),
    ("891", 0.9846648140569512, 0.3955950682670311, "high speech / high visual change"),
    ("895", 0.9973732697122881, 0.05675969550928731, "high speech / low visual change"),
    ("899", 0.983988053639948, 0.06557296720272195, "high speech / low visual change"),
]

# Of 60 questions the group and the z of either option variant, in the order published.
Z = [
    ("605-1", "Reasoning", 12.131531, 8.391897),
    ("605-2", "Perception", 1.9737127, 1.4195185),
    ("605-3", "Reasoning", 1.8931998, 1.6665255),
    ("625-1", "Reasoning", 6.323058, 5.138582),
    ("625-2", "Reasoning", 0.9088485, 0.781249),
    ("625-3", "Perception", 3.612869, 3.9711845),
    ("669-1", "Reasoning", -0.67520493, -1.600745),
    ("669-2", "Reasoning", -1.6904262, -1.9958047),
    ("669-3", "Reasoning", -2.0823836, -2.2219605),
    ("687-1", "Perception", 2.6547012, 2.4369795),
    ("687-2", "Counting/Temporal", 11.304749, 13.626867),
    ("687-3", "Counting/Temporal", 0.11024685, 0.91001815),
    ("705-1", "Perception", 3.9309533, 3.949289),
    ("705-2", "Reasoning", 0.1177775, 0.5834128),
    ("705-3", "Reasoning", -0.14135939, 1.297584),
    ("710-1", "Perception", -0.7737301, 0.0171848),
    ("710-2", "Reasoning", -0.6464392, -0.455088),
    ("710-3", "Reasoning", -0.6834092, 0.028269675),
    ("715-1", "Counting/Temporal", 10.847037, 1.8148336),
    ("715-2", "Reasoning", 4.680665, 4.053055),
    ("715-3", "Reasoning", 2.372729, 2.708107),
    ("722-1", "Reasoning", 0.77656883, 3.7417223),
    ("722-2", "Reasoning", 2.6283603, 0.32700247),
    ("722-3", "Reasoning", 0.6798324, 1.7694633),
    ("739-1", "Reasoning", 1.9773376, 0.6939367),
    ("739-2", "Perception", -1.4127814, -0.90647686),
    ("739-3", "Perception", 0.96778584, -0.56833625),
    ("742-1", "Reasoning", 0.10080274, 0.10906981),
    ("742-2", "Reasoning", -0.34186548, -0.41780034),
    ("742-3", "Counting/Temporal", -0.6532947, -1.6445533),
    ("767-1", "Reasoning", 0.3582047, 0.23688745),
    ("767-2", "Reasoning", 0.104245715, -0.00055808644),
    ("767-3", "Perception", 2.2395637, 2.1951566),
    ("786-1", "Reasoning", -0.53865224, -0.6480526),
    ("786-2", "Perception", 1.7087837, 1.6188245),
    ("786-3", "Reasoning", -0.20932089, -0.26412678),
    ("799-1", "Reasoning", 1.7152474, 1.4869893),
    ("799-2", "Counting/Temporal", 0.20853996, 0.08829315),
    ("799-3", "Perception", 1.1246742, 1.7037714),
    ("805-1", "Counting/Temporal", -0.2840775, -0.11705344),
    ("805-2", "Perception", 2.6081681, 2.8463333),
    ("805-3", "Reasoning", 0.38401592, 0.3602601),
    ("807-1", "Reasoning", 1.078005, 0.7492744),
    ("807-2", "Reasoning", 9.754772, 4.145276),
    ("807-3", "Reasoning", 1.097536, 0.95340145),
    ("827-1", "Reasoning", 1.8471444, 2.2905607),
    ("827-2", "Counting/Temporal", -0.4930889, -0.6127595),
    ("827-3", "Reasoning", 0.43918693, 0.8565825),
    ("857-1", "Perception", 2.2450175, 2.8670123),
    ("857-2", "Reasoning", 3.2075913, 2.7119415),
    ("857-3", "Counting/Temporal", 3.683236, 2.2983677),
    ("871-1", "Reasoning", 1.2214829, 0.73150074),
    ("871-2", "Reasoning", 1.140886, 1.384759),
    ("871-3", "Reasoning", 0.26325133, 0.12717077),
    ("872-1", "Reasoning", 0.4215431, 0.09064111),
    ("872-2", "Perception", 0.52843606, 2.6364546),
    ("872-3", "Perception", 1.0591903, -0.008642311),
    ("900-1", "Reasoning", 1.5397674, 1.8579878),
    ("900-2", "Reasoning", -0.31678128, -0.10078829),
    ("900-3", "Reasoning", 1.5324386, 2.5621905),
]

# The summary published of them: group, variant, n, median z, share above 1.645.
SUMMARY = [
    ("Perception", "template", 14, 1.8412482, 0.5714285714285714),
    ("Perception", "option", 14, 1.9494639999999999, 0.5714285714285714),
    ("Reasoning", "template", 38, 0.728200615, 0.2894736842105263),
    ("Reasoning", "option", 38, 0.74038757, 0.3157894736842105),
    ("Counting/Temporal", "template", 8, 0.159393405, 0.375),
    ("Counting/Temporal", "option", 8, 0.49915565, 0.375),
    ("All", "template", 60, 1.01348807, 0.36666666666666664),
    ("All", "option", 60, 0.883300325, 0.38333333333333336),
]


def test_groups_of_videos(spark):
    df = spark.createDataFrame([v[:3] for v in VIDEOS], "video_id string, subtitle_coverage double, average_visual_change double")
    assert {r.video_id: r.group for r in events.grouped(df).collect()} == {v[0]: v[3] for v in VIDEOS}


@pytest.mark.parametrize("accuracy", [1000, 10_000])
def test_groups_by_sketch(spark, accuracy):
    """A median from a sketch is one of the values, and moves only videos that lie at the median."""
    df = spark.createDataFrame([v[:3] for v in VIDEOS], "video_id string, subtitle_coverage double, average_visual_change double")
    got = {r.video_id: r.group for r in events.grouped(df, accuracy).collect()}
    assert sum(got[v[0]] != v[3] for v in VIDEOS) <= 2


def test_summary_of_the_null(spark):
    df = spark.createDataFrame(Z, "question_id string, g string, template double, option double")
    got = {(r.group, r.variant): (r.n, r.median_z, r.share) for r in stats.signal_summary(df, "g", ["template", "option"]).collect()}
    assert len(got) == len(SUMMARY)
    for group, variant, n, median, share in SUMMARY:
        assert got[group, variant] == (n, pytest.approx(median, abs=1e-6), pytest.approx(share))


def test_pooled_alignment_counts(spark):
    """The published shares are those of 905 visual and 410 text events; an event at a tolerance counts as aligned."""
    # Tolerance, visual events and text events within it.
    within = [(5.0, 51, 51), (10.0, 122, 122), (20.0, 250, 236)]
    rows = []
    for m, n, k in (("visual", 905, 1), ("text", 410, 2)):
        gaps = [5.0] * within[0][k] + [10.0] * (within[1][k] - within[0][k]) + [20.0] * (within[2][k] - within[1][k])
        rows += [("v", m, g) for g in gaps] + [("v", m, float("inf"))] * (n - len(gaps))
    df = spark.createDataFrame(rows, "video_id string, modality string, nearest_other_peak_seconds double")
    got = {r.tolerance_seconds: (r.visual_alignment_fraction, r.text_alignment_fraction) for r in events.alignment(df, (5.0, 10.0, 20.0), by_video=False).collect()}
    # The shares published.
    assert got == {5.0: pytest.approx((0.056353591160221, 0.12439024390243902)), 10.0: pytest.approx((0.13480662983425415, 0.2975609756097561)), 20.0: pytest.approx((0.27624309392265195, 0.5756097560975609))}
