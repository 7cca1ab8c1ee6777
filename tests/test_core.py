"""The catalogue, contracts and the resolution of schedules."""

import inspect
import json
import keyword
import string

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from sluice.plans.config import ACTS, GROUP_ESTIMATORS, METHODS, PRESETS, Part, Plan, check_estimator, plain, preset, read_presets
from sluice.plans.contracts import GRANULARITIES, TIMINGS, Mixer, Reweighter, Scorer, Selector
from sluice.plans.registry import Catalogue, options_of

word = st.text(string.ascii_lowercase, min_size=1, max_size=3)
layer = st.dictionaries(word, st.integers(), max_size=6)


@settings(max_examples=60, deadline=None)
@given(st.lists(layer, max_size=4), st.sets(word, max_size=5))
@example([{"if": 1, "a": 2}], {"if", "a"})
def test_first_layer_decides_and_only_known_options_pass(layers, takes):
    def factory(**kw):
        return kw

    def closed(**kw):
        return dict.fromkeys(takes) | kw

    closed.__signature__ = inspect.Signature([inspect.Parameter(t, inspect.Parameter.KEYWORD_ONLY, default=None) for t in sorted(takes - set(keyword.kwlist))])
    takes = takes - set(keyword.kwlist)
    want = {}
    for one in reversed(layers):
        want |= one
    c = Catalogue()
    assert c.add("k", "open", factory).make(*layers) == want
    assert c.add("k", "closed", closed).make(*layers) == {t: want.get(t) for t in takes}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), word), unique=True, max_size=8))
def test_catalogue_is_a_sorted_set_by_kind(items):
    c = Catalogue()
    for kind, name in items:
        made = c.add(kind, name, lambda: None)
        assert c.find(kind, name) is made
        with pytest.raises(ValueError, match="already"):
            c.add(kind, name, lambda: 1)
    for kind in "ab":
        assert c.names(kind) == sorted(n for k, n in items if k == kind)
        with pytest.raises(KeyError) as e:
            c.find(kind, "?")
        assert all(n in str(e.value) for n in c.names(kind) or ["none"])


def test_constructors_hand_options_to_their_base():
    class Base:
        def __init__(self, low, tie=()):
            pass

    class Open(Base):
        def __init__(self, high, **kw):
            super().__init__(**kw)

    class Any(Base):
        def __init__(self, **kw):
            self.kw = kw

    class Bare:
        pass

    assert options_of(Open) == {"high", "low", "tie"} and options_of(Bare) == frozenset()
    assert options_of(Any) == {"low", "tie"}
    assert options_of(lambda **kw: kw) is None


def test_classes_enter_the_catalogue_by_kind():
    class Half(Scorer, name="test_half"):
        def __init__(self, of=2):
            self.of = of

    assert Scorer.named("test_half", {"of": 4}, {"of": 3, "else": 1}).of == 4 and "test_half" in Scorer.names()
    assert all("test_half" not in k.names() for k in (Selector, Reweighter, Mixer))
    with pytest.raises(ValueError, match="already"):
        type("Again", (Scorer,), {}, name="test_half")


@pytest.mark.parametrize("field,allowed", [("timing", TIMINGS), ("granularity", GRANULARITIES)])
def test_contract_fields(field, allowed):
    for v in allowed:
        assert getattr(type("Fine", (Scorer,), {field: v}), field) == v
    for v in ("", allowed[0].upper(), None):
        before = Scorer.names()
        with pytest.raises(ValueError, match=field):
            type("Wrong", (Scorer,), {field: v}, name="test_wrong")
        assert Scorer.names() == before


def test_estimators():
    for name in Scorer.names():
        s = Scorer.named(name, {"column": "x"})
        for e in (*GROUP_ESTIMATORS, *map(str.upper, GROUP_ESTIMATORS), None, ""):
            check_estimator(s, e)
        for e in ("gae", "reinforce"):
            if s.needs_groups:
                with pytest.raises(ValueError, match=e):
                    check_estimator(s, e)
            else:
                check_estimator(s, e)


def test_every_preset_and_method_resolves():
    for kind, items in PRESETS.items():
        contract = {c.kind: c for c in (Scorer, Selector, Reweighter, Mixer)}[kind]
        for name, options in items.items():
            made = contract.named(name, options, {"domains": ["x"]})
            assert {k: getattr(made, k) for k in options} == options
    for name, cfg in METHODS.items():
        if cfg is None:
            assert name == "baseline"
            continue
        p = Plan.resolve(cfg, given={"domains": ["x", "y"], "tie": ("id",)}, estimator="grpo")
        assert isinstance(p.actuator, ACTS[p.mechanism]) and p.actuator.scorer is p.scorer and p.actuator.tie == ("id",)
        assert (p.warmup_step, p.update_step) == (cfg.get("warmup_step", 0), cfg.get("update_step", 1))
        for k, v in cfg["actuator"].get("params", {}).items():
            assert getattr(p.actuator, k, v) == v


def test_what_is_given_comes_before_configuration_and_presets():
    cfg = {"mechanism": "reweight", "scorer": {"name": "advantage_magnitude", "params": {"agg": "max"}}, "actuator": {"name": "difficulty_band", "params": {"low_q": 0.1, "high_q": 0.6, "colour": "red"}}}
    p = Plan.resolve(cfg, given={"high_q": 0.9}, presets={"reweighter": {"difficulty_band": {"focus_weight": "7", "low_q": 0.2}}})
    a = p.actuator
    assert (a.low_q, a.high_q, a.focus_weight, p.scorer.agg) == (0.1, 0.9, "7", "max")


@pytest.mark.parametrize("change", [{"mechanism": "sort"}, {"mechanism": None}, {"actuator": {"name": "topk_fraction"}, "mechanism": "select", "scorer": {"name": "token_prob"}}])
def test_bad_schedules(change):
    good = {"mechanism": "reweight", "scorer": {"name": "advantage_magnitude"}, "actuator": {"name": "softmax"}}
    Plan.resolve(good)
    with pytest.raises(ValueError):
        Plan.resolve(good | change)
    with pytest.raises(KeyError):
        Plan.resolve(good | {"actuator": {"name": "nowhere"}})


def test_configuration_nodes():
    class Node:
        def __init__(self):
            self.name, self.params = "softmax", {"temperature": 2}

    assert plain(None) == {} and plain(Node())["name"] == "softmax" and plain({"a": 1}) == {"a": 1}
    assert Part.of(Node()).make(Reweighter, {}, None).temperature == 2


def test_presets_of_a_file(tmp_path):
    at = tmp_path / "presets.json"
    at.write_text(json.dumps({"scorers": {"static_meta": {"name": "static_meta", "params": {"column": "${col}_${other}"}}}, "mixer": {"tscl": {"floor": 0.5}}}))
    t = read_presets(str(at))
    assert preset("scorer", "static_meta", t, {"col": "len"}) == {"column": "len_${other}"}
    assert preset("mixer", "tscl", t) == {"floor": 0.5} and preset("mixer", "static", t) == {} and preset("none", "x", t) == {}
