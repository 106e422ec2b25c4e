"""What stored patterns name, by their JSON, against the walk over the pattern itself."""

import json

from quernstone.operators import governance
from quernstone.plans.assessment import CRITERIA, RULES


def test_references_of_stored_patterns(spark):
    patterns = [(k, p) for k, p, _ in CRITERIA] + [(r.key, r.pattern) for r in RULES]
    patterns.append(("X", {"op": "and", "operands": [{"op": "class_membership", "property": "p", "classes": ["A", "B"]}, {"op": "external_alignment", "property": "q", "alignment": "http://x/1"}]}))
    stored = spark.createDataFrame([(k, json.dumps(p)) for k, p in patterns], "rule string, pattern string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(governance.references_in(stored)) == rows(governance.reference_table(spark, patterns)) != []
    assert governance.references_in(stored.limit(0)).count() == 0
