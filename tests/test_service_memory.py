"""A service's memory in order of size gives what the rule's own step over all of it gives, and looks at few values a step."""

import random

import pytest

from flowharbor.streaming.states import MemoryRule, ServiceMemory


@pytest.mark.parametrize("size,top,odd", [(64, 5, False), (6, 3, False), (4, 5, False), (12, 3, True)])
def test_steps_equal_the_rule(size, top, odd):
    draw = random.Random(size)
    rule = MemoryRule(4.0, size, 0.5, 0.95, top)
    memory, values, trust = ServiceMemory(rule), [], 1.0
    for i in range(4000):
        value = float("nan") if odd and i in (50, 900) else draw.choice([draw.randrange(18) * 1.0, draw.random() * 9, -0.0])
        score, forced = draw.choice([0.1, 5.0]), draw.random() < 0.05
        got, admit, values, trust = rule.step(values, trust, value, score, forced)
        assert repr((*memory.step(value, score, forced), memory.trust)) == repr((got, admit, trust))
        assert repr([*memory.values]) == repr(values)


def test_a_step_looks_at_few_values(monkeypatch):
    seen = []
    monkeypatch.setattr("flowharbor.streaming.states.abs", lambda x: seen.append(x) or (x if x >= 0 else -x), raising=False)
    memory = ServiceMemory(MemoryRule(4.0, 500, 0.5, 0.95, 5), [float(i % 7) for i in range(500)])
    memory.step(3.5, 0.0, False)
    assert 0 < len(seen) <= 10
