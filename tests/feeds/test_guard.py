"""The guard: what it finds, what it lets through, and what guarded code runs with."""

import importlib
import types

import pytest

from sluice.errors import PlanError
from sluice.operators import guard
from sluice.operators.custom import apply_transform



def module_hops():
    """Each allowed module's way to each module that it holds, and to one below it, by attribute and by import."""
    out = []
    for name in sorted(guard.TRANSFORM_MODULES - {"__future__"}):
        members = sorted(n for n, v in vars(importlib.import_module(name)).items() if isinstance(v, types.ModuleType) and not guard._module(v.__name__, guard.TRANSFORM_MODULES))
        out += [f"import {name}\n{name}.{m}" for m in members] + [f"from {name} import {m}" for m in members]
        out += [f"import {name} as z\nz.{m}" for m in members]
    return out


HOSTILE = module_hops() + [
    # files, in ways other than reading
    "open('f', 'a')", "open('f', 'rb+')", "open(file='f', mode='x')", "open('f', **{'mode': 'a'})", "open(*('f', 'a'))", "k = [open]\nk[0]('f', 'a')", "m = 'a'\nopen('f', m)",
    "from io import FileIO", "import io\nio.FileIO('f', 'a')", "import io\nq = io.open", "p = 1\np.open('a')", "from pathlib import Path\nPath('f').touch()", "from pathlib import Path\nPath('f').rmdir()",
    "import pathlib\nk = pathlib.Path\nk('f').write_bytes(b'')", "class A:\n    rename = 1\nA().rename",
    "from pathlib import Path\nPath('a').replace('b')", "from pathlib import Path\nPath('a').replace(target='b')", "from pathlib import Path\nf = Path('a').replace\nf('b')", "from pathlib import Path\nPath('a').replace(*['b'])",
    # modules as values, whatever else has the name
    "import typing\ndef f(typing):\n    return typing\nclass A:\n    def sys(self): pass\n    def modules(self): pass\nf(typing).sys.modules['os']",
    "import re\nclass A:\n    def __init__(self, t):\n        self.sys = self.modules = t\nA(re)", "import re\nmatch re:\n    case re:\n        re.x", "import re\n[re for re in [re]]",
    "import re\nre = re", "import re as q\nfor q in [q]:\n    pass", "import json\nlambda json: json", "import csv\ntry:\n    pass\nexcept ValueError as csv:\n    pass", "import typing as t\ny = t", "import io\nx = {1: io}",
    "class A:\n    os = 1\nA().os", "x = 1\nx.modules",
    # reflection
    "__import__('abc')", "setattr(1, 'x', 2)", "''.__class__.__mro__", "k = exec", "eval('1')", "globals()", "memoryview(b'')", "def g():\n    yield\ng().gi_frame", "f'{[].__class__}'", "from typing import *", "import typing\ntyping.get_type_hints(1)",
]


@pytest.mark.parametrize("source", HOSTILE)
def test_hostile(source):
    assert guard.scan(source), source


SOUND = '''
from __future__ import annotations
import csv, collections.abc, json, re, time
from collections import Counter, defaultdict
from dataclasses import dataclass
from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path

@dataclass
class Row:
    key: str

    def loud(self):
        return self.key.upper()

def extract(path):
    with open(path, encoding="utf-8", newline="") as f:
        for r in csv.DictReader(f, delimiter=";"):
            yield {k.strip(): v for k, v in r.items()}
    with Path(path).open("r") as f:
        return f.read().splitlines()

def transform(rows):
    seen, out = defaultdict(int), []
    for i, r in enumerate(rows):
        try:
            day = datetime.strptime(r["d"], "%d/%m/%Y").date().isoformat()
        except (ValueError, KeyError) as e:
            raise RuntimeError(str(e)) from e
        noon = datetime(2020, 1, 1).replace(hour=12)
        assert noon and r["a"].replace(",", "", 1)
        amount = Decimal(r["a"].replace(",", "")).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
        seen[day] += 1
        m = re.match(r"x(?P<n>.*)", r["a"])
        out.append({"d": day, "a": f"{amount:.2f}", "x": m.group("n") if m else "", "k": Row(key="x").loud()})
    assert isinstance(rows, collections.abc.Iterable)
    time.sleep(0)
    return sorted(out, key=lambda q: (q["d"], Counter(q["a"]).most_common(1)))

if __name__ == "__main__":
    print(json.dumps(transform([])))
'''
GRAPH = '''
from airflow import DAG
from airflow.operators.python import PythonOperator
import pipeline
with DAG("x", schedule="0 6 * * *") as dag:
    a = PythonOperator(task_id="extract", python_callable=pipeline.extract)
    b = PythonOperator(task_id="transform", python_callable=pipeline.transform)
    a >> b
    a.set_downstream(b)
'''


def test_sound():
    assert guard.scan(SOUND) == [] and guard.scan(GRAPH, guard.DAG_MODULES) == []
    assert guard.scan("def\n")[0]["line"] == 1 and [f["line"] for f in guard.scan("import os\n\nimport sys\n")] == [1, 3]


def test_guarded_code_runs_with_few_builtins():
    space = {"__builtins__": guard.builtins_of()}
    exec("import json\nfrom decimal import Decimal\nclass A:\n    pass\nn = len(json.dumps([1])) + int(Decimal(2))", space)
    assert space["n"] == 5
    for bad, error in (("import os", ImportError), ("open('/tmp/none', 'w')", PermissionError), ("eval('1')", NameError), ("getattr(1, 'real')", NameError)):
        with pytest.raises(error):
            exec(bad, {"__builtins__": guard.builtins_of()})


def test_transform_sees_whole_files(spark):
    source = "def transform(rows):\n    n = 0\n    out = []\n    for r in rows:\n        n += int(r['v'])\n        out.append({'trade_id': str(n), 'account_id': ','.join(sorted(r))})\n    return out\n"
    rows = spark.createDataFrame([(f"f{i % 3}", i, "1") for i in range(300)], "sample string, idx long, v string").repartition(7)
    got = apply_transform(rows, source, by="sample", order="idx").collect()
    assert {(r.sample, int(r.trade_id)) for r in got} == {(f"f{k}", n) for k in range(3) for n in range(1, 101)} and {r.account_id for r in got} == {"v"}
    with pytest.raises(PlanError):
        apply_transform(rows, "def transform(rows):\n    return open('x', 'w')\n", by="sample")
