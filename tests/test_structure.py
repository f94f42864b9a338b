"""Structural primitives read from token sequences."""

import pytest

from flowharbor.operators import structure as T

SCHEMA = "flow string, pos long, token string"


def packet(way, size, gap, *more):
    return [f"PKT_DIR_{way}", f"PKT_LEN_{size}", f"PKT_IAT_{gap}", *more]


def burst(count, up, down, way, gap, mean):
    return [f"BURST_PKTN_{count}", "BURST_DUR_0", f"BURST_BYTES_C2S_{up}", f"BURST_BYTES_S2C_{down}", f"BURST_DIR_{way}", "BURST_IAT_MED_1", f"BURST_GAP_NEXT_{gap}", f"BURST_LEN_MEAN_{mean}", "BURST_LEN_STD_0"]


def frame(spark, **flows):
    return spark.createDataFrame([(flow, i, token) for flow, tokens in flows.items() for i, token in enumerate(tokens)], SCHEMA)


def fired(spark, limits=T.Limits(), **flows):
    rows = T.triggers(*T.token_events(frame(spark, **flows)), limits).collect()
    return {(r.flow, r.name.removeprefix("PRIM_STRUCT_")): (r["count"], r.first_pos) for r in rows}


UP = [t for k in ("START", "MID", "END") for t in packet("C2S", 3, 1, f"BURST_{k}")]
TURN = ["[CLS]", "FLOW_PKTN_5", *UP, *packet("S2C", 10, 12, "BURST_SINGLE"), *burst(1, 7, 0, "C2S", 1, 3), *burst(1, 0, 7, "S2C", 1, 10), "[SEP]"]


def test_a_request_and_its_answer(spark):
    found = fired(spark, f=TURN)
    assert found["f", "PKT_C2S_SMALL_RUN_3"] == (1, 2)
    assert found["f", "PKT_SAME_LEN_RUN_C2S_3_L3"] == (1, 2)
    assert found["f", "PKT_LEN_SPIKE"] == (1, 14)
    assert found["f", "BURST_REQ_RESP_PAIR"] == (1, None)
    assert found["f", "DIR_TWO_PHASE_C2S_THEN_S2C"] == (1, 3)  # a turn's place counts packets
    assert found["f", "IAT_BURSTY_THEN_IDLE"] == (1, 2)
    # the last event is the second burst at token 27: 2 is in the first third, 14 in the second
    assert found["f", "POS_PREFIX_C2S_SMALL_RUN"] == (1, 2)
    assert found["f", "POS_MIDDLE_LEN_SPIKE"] == (1, 14)
    assert not any("TWO_PHASE" in name and name.startswith("POS") for _, name in found)
    assert found["f", "PARAM_BURST_COUNT_LE_3"] == (1, None)


def test_events_stand_at_their_tokens(spark):
    odd = ["BURST_START", *packet("C2S", 4, 0), "PKT_DIR_S2C", "PKT_IAT_2", "PKT_LEN_1", *burst(2, 1, 5, "MIXED", 3, 6), "BURST_GAP_NEXT_9", "[SEP]", "BURST_DIR_C2S", *packet("S2C", "X", 99, "PRIM_PROFILE_NONE"), "BURST_PKTN_1", "BURST_MID", "PKT_DIR_C2S"]
    packets, bursts = T.token_events(frame(spark, f=odd, none=["[CLS]", "[SEP]"]).unionByName(spark.createDataFrame([(None, 0, "PKT_DIR_C2S"), ("f", None, "BURST_PKTN_9"), ("g", 0, None)], SCHEMA)))
    assert sorted(tuple(r) for r in packets.collect()) == [("f", 0, 1, "C2S", 4, 0), ("f", 1, 19, "S2C", 0, 99)]
    got = [r.asDict() for r in bursts.orderBy("b").collect()]
    assert got == [
        {"flow": "f", "b": 1, "pos": 7, "dir": "MIXED", "pktn": 2, "len_mean": 6, "gap_next": 9, "c2s": 1, "s2c": 5},
        {"flow": "f", "b": 2, "pos": 23, "dir": None, "pktn": 1, "len_mean": None, "gap_next": None, "c2s": 0, "s2c": 0},
    ]


def test_bursts_without_packets_and_without_fields(spark):
    pair = lambda way: ["BURST_PKTN_1", f"BURST_DIR_{way}", "BURST_GAP_NEXT_1"]
    turns = [t for way in ("C2S", "S2C", "C2S", "S2C") for t in pair(way)]
    gone = [*pair("C2S"), "BURST_PKTN_1", *pair("S2C")]
    found = fired(spark, turns=turns, gone=gone, bare=["BURST_PKTN_2", "BURST_PKTN_2"])
    assert found["turns", "BURST_REQ_RESP_REPEAT_2"] == (1, None) and found["turns", "BURST_ALT_FAST"] == (1, None)
    assert found["turns", "BURST_INTERVAL_PERIODIC"] == (1, None) and found["turns", "PARAM_REQ_RESP_REPEAT_LE_2"] == (1, None)
    assert found["turns", "BURST_SHORT_MANY"] == (1, None)
    assert ("gone", "BURST_REQ_RESP_PAIR") in found and ("gone", "PARAM_BURST_COUNT_LE_3") in found
    # bursts that have no direction at all repeat no template
    assert {name for flow, name in found if flow == "bare"} == {"PARAM_BURST_COUNT_LE_3"}


def test_families_that_are_not_wanted_fire_nothing_and_feed_nothing(spark):
    beat = [t for _ in range(5) for t in packet("C2S", 3, 4)]
    every = fired(spark, f=beat)
    assert ("f", "COMP_FAST_C2S_SMALL_REPEAT") in every and ("f", "COMP_SHORT_FLOW_SAME_LEN_C2S") in every
    some = fired(spark, T.Limits(families=("packet_shape", "composite", "direction_transition")), f=beat)
    assert ("f", "COMP_SHORT_FLOW_SAME_LEN_C2S") in some and ("f", "COMP_FAST_C2S_SMALL_REPEAT") not in some
    assert not any(name.startswith(("POS_", "PARAM_", "IAT_")) for _, name in some)
    assert not any(name.startswith("COMP_") for _, name in fired(spark, T.Limits(families=("timing_rhythm", "composite")), f=beat))


@pytest.mark.parametrize("tokens", [[], ["[CLS]", "[SEP]"]])
def test_no_events_no_triggers(spark, tokens):
    assert fired(spark, f=tokens) == {}
