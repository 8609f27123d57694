from codeloom.llm.common import Memo, fresh, released


def test_long_keys_are_not_kept_and_tables_end_with_the_task():
    asked = []
    memo = Memo(lambda k: asked.append(k) or len(k), limit=3, longest=4)
    assert [memo[k] for k in ("a", "a", "toolong", "toolong")] == [1, 1, 7, 7]
    assert asked == ["a", "toolong", "toolong"] and dict(memo) == {"a": 1}
    for k in "bcdef":
        memo[k]
        assert len(memo) <= 3
    assert list(released(iter([1, 2]), memo.clear)) == [1, 2] and not memo
    memo["x"]
    stopped = released(iter([1, 2]), memo.clear)
    next(stopped)
    stopped.close()
    assert not memo


def test_fresh_names():
    assert fresh("a", "b") == "a" and fresh("a", "A", "a_") == "a__"
