"""Bounds, compaction policy, manifest folding and the shell's grammar, without Spark."""

import pytest

from tidemark.model import UNBOUNDED, KeyRange, LeveledOptions, TableOptions, check_record, excluded, included
from tidemark.plans.compaction import Levels, Task, apply, empty_levels, full, pick
from tidemark.shell import parse
from tidemark.sources.manifest import FileEntry, Manifest, Snapshot
from tidemark.sources.store_fs import LocalFiles


@pytest.mark.parametrize("lower,upper,inside", [(included("b"), included("d"), "bcd"), (included("b"), excluded("d"), "bc"), (excluded("b"), included("d"), "cd"), (excluded("b"), excluded("d"), "c"), (UNBOUNDED, included("b"), "ab"), (excluded("d"), UNBOUNDED, "e"), (UNBOUNDED, UNBOUNDED, "abcde"), (included("d"), included("b"), "")])
def test_holds(lower, upper, inside):
    keys = KeyRange(lower, upper)
    assert "".join(c for c in "abcde" if keys.holds(c.encode())) == inside


def test_overlap_at_the_ends():
    assert KeyRange(included("d"), UNBOUNDED).overlaps(b"a", b"d")
    assert not KeyRange(excluded("d"), UNBOUNDED).overlaps(b"a", b"d")
    assert KeyRange(UNBOUNDED, included("a")).overlaps(b"a", b"d")
    assert not KeyRange(UNBOUNDED, excluded("a")).overlaps(b"a", b"d")


def test_records():
    check_record(b"k", None)
    for key, value in ((b"", b"v"), (b"k", b""), (b"k" * 65_536, b"v"), (b"k", b"v" * 65_536)):
        with pytest.raises(ValueError):
            check_record(key, value)


def levels(*counts):
    names = [tuple(f"{n}-{k}" for k in range(c)) for n, c in enumerate(counts)]
    return Levels(names[0], tuple(names[1:]))


@pytest.mark.parametrize("counts,upper", [((1, 0, 0, 0), None), ((2, 0, 0, 0), 0), ((2, 4, 0, 0), 1), ((2, 3, 9, 0), 0), ((0, 0, 0, 0), None), ((0, 0, 7, 0), 2), ((2, 4, 8, 16), None)])
def test_pick(counts, upper):
    task = pick(levels(*counts), LeveledOptions(200, 2, 3))
    assert (task.upper if task else None) == upper
    if task:
        assert task.bottom == (task.lower == 3)


def test_apply_keeps_new_files():
    before = levels(2, 1, 0, 0)
    task = pick(before, LeveledOptions(200, 2, 3))
    after = apply(Levels(("new", *before.level0), before.levels), task, ("out",))
    assert after.level0 == ("new",) and after.levels[0] == ("out",)
    with pytest.raises(ValueError):
        apply(after, task, ("x",))


def test_full_and_presets():
    assert full(levels(1, 2)).lower_files == ("1-0", "1-1")
    assert len(empty_levels(None).levels) == 1 and len(empty_levels(LeveledOptions()).levels) == 4
    assert TableOptions.small_buffers().memtable_limit == 2 and TableOptions.compacting(None).target_file_size == 1 << 20


def entry(name, first, last):
    return FileEntry(name, first, last, 1, 1, 1, 1)


def test_manifest_folds_every_kind(tmp_path):
    files = LocalFiles(str(tmp_path))
    log = Manifest(files)
    log.commit({"kind": "create", "levels": 1})
    log.commit({"kind": "memtable", "id": 1})
    log.commit({"kind": "flush", "id": 1, "add": [entry("a", b"a", b"c").to_json()]})
    log.commit({"kind": "ingest", "batch": "x/1", "add": [entry("b", b"b", b"d").to_json()]})
    state = log.snapshot()
    assert state.levels.level0 == ("b", "a") and state.memtables == () and state.batches == {"x/1"}
    from tidemark.sources.manifest import task_json

    log.commit({"kind": "compact", "task": task_json(full(state.levels)), "add": [entry("c", b"a", b"d").to_json()]})
    again = Manifest(LocalFiles(str(tmp_path))).snapshot()
    assert again.levels == Levels((), (("c",),)) and set(again.entries) == {"c"}
    assert Manifest(files).snapshot(4).levels.level0 == ("b", "a")


def test_a_lost_race_is_tried_again(tmp_path):
    files = LocalFiles(str(tmp_path))
    one, two = Manifest(files), Manifest(files)
    one.commit({"kind": "create", "levels": 1})
    two.snapshot()
    one.commit({"kind": "ingest", "add": [entry("a", b"a", b"a").to_json()]})
    two.commit({"kind": "ingest", "add": [entry("b", b"b", b"b").to_json()]})
    assert one.snapshot().levels.level0 == ("b", "a")
    with pytest.raises(FileExistsError):
        files.create("_log/00000000000000000001.json", b"{}")


def test_levels_are_checked():
    entries = {"x": entry("x", b"a", b"c"), "y": entry("y", b"c", b"d"), "z": entry("z", b"e", b"e")}
    assert len(Snapshot(1, Levels((), (("x", "y", "z"),)), entries).check_levels()) == 1
    assert not Snapshot(1, Levels((), (("x", "z"),)), entries).check_levels()


def test_grammar():
    assert parse("SCAN a b").arguments == ("a", "b") and parse("quite").name == "quite"
    assert parse('update 100 "hi"').arguments[1] == '"hi"'
    for line in ("", "scan a", "get", "fill a b", "what", "flush now"):
        with pytest.raises(ValueError):
            parse(line)


def test_task_type():
    assert Task(0, ("a",), 1, (), False).lower == 1
