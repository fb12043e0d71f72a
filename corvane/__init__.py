"""Rules over text corpora as Spark plans: scan, lines, rules, violations, pairs, state and reports."""
