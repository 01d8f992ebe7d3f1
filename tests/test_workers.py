"""Python workers do not need this package."""

import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
sys.path.insert(0, sys.argv[1])
from turnwise import local_session
from turnwise.operators.classify import RULE_SCHEMA, matching_rules, rule_problems
spark = local_session(1, memory="1g")
rules = spark.createDataFrame([(1, "[", "regex", "{}", 0, True), (2, "elm.*", "regex", '{"type":"tag"}', 0, True)], RULE_SCHEMA)
names = spark.createDataFrame([("elm_oak", "text"), ("oak_elm", "text")], "column_name string, inferred_type string")
print("found", rule_problems(rules).count(), "matched", matching_rules(names, rules).count())
"""


def test_rules_are_checked_without_the_package_on_workers(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM, root],
        cwd=tmp_path, capture_output=True, text=True, timeout=180, check=False,
    )
    assert "found 1 matched 1" in done.stdout, done.stderr[-2000:]
