"""Guarded code in a process of its own: what the guard would miss ends there, and the worker goes on."""

import os

import pytest

from sluice.errors import PlanError
from sluice.operators import custom, guard, jail
from sluice.schemas import H1

TRANSFORM = "def transform(rows):\n    return [{'trade_id': r['v'], 'amount': len(r['v'])} for r in rows]\n"
REACH = "import typing\nm = typing.sys.modules\n"
#: Each would work in the worker itself; none does here.
ESCAPES = {
    "command": REACH + "def transform(rows):\n    m['os'].system('true')\n    return []\n",
    "child": REACH + "def transform(rows):\n    m['os'].fork()\n    return []\n",
    "program": REACH + "def transform(rows):\n    m['os'].execv('/bin/true', ['true'])\n    return []\n",
    "kill": REACH + "def transform(rows):\n    m['os'].kill(m['os'].getppid(), 9)\n    return []\n",
    "read": "def transform(rows):\n    return [{'trade_id': open('/etc/hostname').read()}]\n",
    "read_path": "from pathlib import Path\ndef transform(rows):\n    return [{'trade_id': Path('/etc/hostname').read_text()}]\n",
    "write": "from pathlib import Path\ndef transform(rows):\n    Path('{tmp}/made').write_text('x')\n    return []\n",
    "rename": "from pathlib import Path\ndef transform(rows):\n    Path('{tmp}/kept').replace('{tmp}/gone')\n    return []\n",
    "remove": "from pathlib import Path\ndef transform(rows):\n    Path('{tmp}/kept').unlink()\n    return []\n",
    "pipe_file": REACH + "def transform(rows):\n    m['os'].mkfifo('{tmp}/made')\n    return []\n",
    "raw_open": REACH + "def transform(rows):\n    m['posix'].open('{tmp}/made', 65)\n    return []\n",
    "list": REACH + "def transform(rows):\n    return [{'trade_id': x} for x in m['os'].listdir('/')]\n",
    "limits": REACH + "def transform(rows):\n    m['resource'].setrlimit(m['resource'].RLIMIT_AS, (-1, -1))\n    return []\n",
    "socket": REACH + "def transform(rows):\n    m['socket'].socket()\n    return []\n",
    "module": "def transform(rows):\n    import ctypes\n    return []\n",
    "real_import": REACH + "def transform(rows):\n    m['builtins'].__import__('wave')\n    return []\n",
    "objects": REACH + "def transform(rows):\n    return [{'trade_id': str(len(m['gc'].get_objects()))}]\n",
    "memory": "def transform(rows):\n    x = [bytes(1 << 20) for _ in range(1 << 12)]\n    return []\n",
    "loop": "def transform(rows):\n    while True:\n        pass\n",
    "sleep": "import time\ndef transform(rows):\n    time.sleep(1000)\n    return []\n",
    "exit": REACH + "def transform(rows):\n    m['os']._exit(0)\n",
    "raise_exit": "def transform(rows):\n    raise SystemExit\n",
    "no_rows": "def transform(rows):\n    return [1, 2]\n",
    "none": "def transform(rows):\n    return None\n",
    "deep": "def transform(rows):\n    return transform(rows)\n",
    "env": REACH + "def transform(rows):\n    return [{'trade_id': m['os'].environ['PATH']}]\n",
    "false_end": REACH + "def transform(rows):\n    w = [m['os'].write(n, b'[7]\\n') for n in range(3, 64) if 0]\n    raise KeyError('x')\n",
    "long_answer": "def transform(rows):\n    while True:\n        yield {'trade_id': 'x' * (1 << 16)}\n",
}
LIMITS = jail.Limits(memory=256 << 20, seconds=2.0, answer=8 << 20)


@pytest.mark.parametrize("name", sorted(ESCAPES))
def test_escape(name, tmp_path):
    (tmp_path / "kept").write_text("x")
    with pytest.raises(jail.JailError):
        jail.run(ESCAPES[name].replace("{tmp}", str(tmp_path)), "transform", [{"v": "a"}], limits=LIMITS)
    assert [p.name for p in tmp_path.iterdir()] == ["kept"]
    assert jail.run(TRANSFORM, "transform", [{"v": "abc"}], limits=LIMITS) == [{"trade_id": "abc", "amount": "3"}]


def test_plain_code(tmp_path):
    source = (
        "import csv, json, re, math, collections\nfrom dataclasses import dataclass\nfrom datetime import datetime\nfrom decimal import Decimal\nfrom pathlib import Path\n"
        "@dataclass\nclass R:\n    k: str\nP = collections.namedtuple('P', 'a b')\n"
        "def transform(path):\n    with open(path, newline='') as f:\n        for r in csv.DictReader(f):\n"
        "            yield {'trade_id': R(r['k']).k, 'value_date': datetime.strptime(r['d'], '%d %b %Y').date().isoformat(), 'amount': str(Decimal(r['a']) * 2), 'currency': None}\n"
        "    yield {'trade_id': Path(path).read_text(encoding='cp1252')[:1] + str(P(1, 2).b) + json.dumps([math.pi > 3]) + re.sub('x', 'y', 'x')}\n"
    )
    (tmp_path / "in.csv").write_text("k,d,a\n1,03 Feb 2026,1.5\n")
    got = jail.run(source, "transform", [], root=str(tmp_path), argument=str(tmp_path / "in.csv"))
    assert got == [{"trade_id": "1", "value_date": "2026-02-03", "amount": "3.0", "currency": None}, {"trade_id": "k2[true]y"}]


def test_links_out_of_the_folder(tmp_path):
    inside = tmp_path / "in"
    inside.mkdir()
    (tmp_path / "secret").write_text("x")
    os.symlink(tmp_path / "secret", inside / "link")
    source = "def transform(path):\n    return [{'trade_id': open(path).read()}]\n"
    for path in (inside / "link", inside / ".." / "secret", tmp_path / "insider"):
        with pytest.raises(jail.JailError):
            jail.run(source, "transform", [], root=str(inside), argument=str(path))


def test_no_files_or_processes_are_left():
    before = set(os.listdir("/proc/self/fd"))
    for _ in range(5):
        jail.run(TRANSFORM, "transform", [{"v": "a"}])
        with pytest.raises(jail.JailError):
            jail.run(ESCAPES["exit"], "transform", [], limits=LIMITS)
    assert set(os.listdir("/proc/self/fd")) == before
    with pytest.raises(ChildProcessError):
        os.waitpid(-1, os.WNOHANG)


def test_files_that_fail_are_findings(spark, tmp_path):
    source = (
        "import typing\ndef transform(rows):\n    if rows[0]['v'] == '3':\n        typing.sys.modules['os'].system('true')\n    if rows[0]['v'] == '4':\n        x = [bytes(1 << 20) for _ in range(1 << 12)]\n"
        "    if rows[0]['v'] == '5':\n        while True:\n            pass\n    return [{'trade_id': r['v']} for r in rows]\n"
    )
    rows = spark.createDataFrame([(f"f{i % 8}", i, str(i % 8)) for i in range(80)], "sample string, idx long, v string").repartition(2)
    with pytest.raises(PlanError):
        custom.try_transform(rows, source, "sample")
    tried = custom.try_transform(rows, source, "sample", "idx", LIMITS, scan=False).collect()
    good = [(r.sample, r.trade_id) for r in tried if r.fault is None]
    assert sorted(good) == sorted((f"f{k}", str(k)) for k in (0, 1, 2, 6, 7) for _ in range(10))
    assert {r.sample: r.fault.split(":")[0] for r in tried if r.fault} == {"f3": "PermissionError", "f4": "MemoryError", "f5": "TimeoutError"}
    found = custom.runtime_faults(spark.createDataFrame(tried), "c", "sample").collect()
    assert {(r.sample, r.check, r.severity) for r in found} == {(f"f{k}", H1, "error") for k in (3, 4, 5)}


KEEPS_COUNT = (
    "from decimal import Decimal\nseen = []\ndef transform(rows):\n    total = Decimal(0)\n    for r in rows:\n        seen.append(r['v'])\n        total += Decimal(r['v'])\n"
    "        yield {'trade_id': r['v'], 'account_id': str(len(seen)), 'amount': str(total), 'description': r['w']}\n"
)


def forks():
    with open("/proc/stat") as f:
        return int(next(x for x in f if x.startswith("processes")).split()[1])


@pytest.mark.parametrize("tried", [False, True])
def test_small_files_share_children(spark, tried):
    """A child a file took longer than the work; in a shared one each file still has a module of its own, and its rows in order."""
    files, n = 2500, 3
    rows = spark.createDataFrame([(None if f == 7 else f, None if i == n - 1 else -i, str(f * 10 + i), None if i else "x") for f in range(files) for i in range(n)], "part long, at long, v string, w string")
    before = forks()
    made = (custom.try_transform if tried else custom.apply_transform)(rows.repartition(3), KEEPS_COUNT, "part", "at").collect()
    assert forks() - before < files // 2
    want = []
    for f in range(files):
        total = 0
        for k, i in enumerate([*range(n - 2, -1, -1), n - 1]):
            total += f * 10 + i
            want.append((None if f == 7 else f, str(f * 10 + i), str(k + 1), str(total), "" if i else "x"))
    assert sorted(((r.part, r.trade_id, r.account_id, r.amount, r.description) for r in made), key=str) == sorted(want, key=str)
    assert not tried or all(r.fault is None for r in made)


def test_shared_children_judge_as_own_ones():
    source = (
        "def deep(n):\n    return deep(n + 1)\ndef transform(rows):\n    v = rows[0]['v'] if rows else ''\n    if v == 'key':\n        rows[0]['none']\n    if v == 'exit':\n        raise StopIteration(v)\n    if v == 'deep':\n        deep(0)\n"
        "    if v == 'memory':\n        x = [bytes(1 << 20) for _ in range(1 << 12)]\n    if v == 'loop':\n        while True:\n            pass\n    if v == 'read':\n        open('/etc/hostname')\n    if v == 'long':\n        return ({'a': 'x' * (1 << 16)} for _ in iter(int, 1))\n"
        "    if v == 'none':\n        return None\n    return [{'trade_id': r['v']} for r in rows] * 3\n"
    )
    assert guard.leaves_nothing(source)
    files = [[{"v": v}] if v else [] for v in ("a", "key", "b", "exit", "deep", "", "c", "memory", "loop", "d", "read", "long", "none", "e\n", "key")]
    shared, own = (list(jail.run_each(source, "transform", files, together, LIMITS)) for together in (True, False))
    assert [x if isinstance(x, list) else str(x) for x in shared] == [x if isinstance(x, list) else str(x) for x in own]
    assert [len(x) if isinstance(x, list) else str(x).split(":")[0] for x in own] == [
        3, "KeyError", 3, "StopIteration", "RecursionError", 0, 3, "MemoryError", "TimeoutError", 3, "PermissionError", "the answer is over 8388608 bytes", "TypeError", 3, "KeyError",
    ]


T = "def transform(rows):\n    return rows\n"


@pytest.mark.parametrize("source", [
    T, KEEPS_COUNT, "import re, math\nP = re.compile('a')\ndef transform(rows):\n    return [{'a': P.sub('b', r['v']).strip() + str(math.pi)} for r in rows]\n",
    "from datetime import datetime as d\ndef transform(rows):\n    return [{'a': d.strptime(r['v'], '%Y').date().isoformat()} for r in rows]\n",
])
def test_what_leaves_nothing(source):
    assert guard.leaves_nothing(source)


@pytest.mark.parametrize("source", [
    "import decimal\n" + T + "decimal.getcontext()\n", "from decimal import getcontext\n" + T, "import csv\n" + T + "csv.field_size_limit(3)\n", "import math\n" + T + "math.pi = 3\n",
    "import json\n" + T + "json.loads = 1\n", "from dataclasses import dataclass\n" + T, "import functools\n" + T, "import collections.abc\n" + T, "import collections\n" + T + "collections.abc\n",
    "class A:\n    def f(self):\n        self.x = 1\n" + T, "gi_frame = 1\n" + T + "(x for x in ()).gi_frame\n", T + "'{0.gi_frame}'.format(1)\n", "def transform(rows):\n    match rows:\n        case object(gi_frame=f):\n            return f\n",
    "import os\n" + T, "not python", "import typing\n" + T, "import re as math\n" + T + "math.Scanner\n",
])
def test_what_may_leave_something(source):
    assert not guard.leaves_nothing(source)
