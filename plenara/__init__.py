"""Plenara: Spark-first analytics for deliberation and document-evaluation data."""

from plenara.functions.text import direct_identifier, is_yes_no_question, question_fingerprint, scenario_id
from plenara.functions.votes import brier, entropy, prop_test, rating_to_vote, separation, skill, two_prop_test
from plenara.operators.forecast import cell_scores
from plenara.operators.generate import TEMPLATES, canonical, scenario, scenarios, sessions
from plenara.operators.matrix import comment_stats, vote_spread
from plenara.operators.validate import feedback_violations, human_violations, scenario_violations, snapshot_violations
from plenara.plans.findings import finding_scores, question_metrics, scenario_tasks
from plenara.plans.floors import vote_floors
from plenara.sources.jsonl import load_scenarios, load_snapshots
from plenara.sources.schemas import HUMAN_SNAPSHOT, SCENARIO, SNAPSHOT

__all__ = [
    "HUMAN_SNAPSHOT", "SCENARIO", "SNAPSHOT", "TEMPLATES", "brier", "canonical", "cell_scores", "comment_stats", "direct_identifier", "entropy", "feedback_violations", "finding_scores",
    "human_violations", "is_yes_no_question", "load_scenarios", "load_snapshots", "prop_test", "question_fingerprint", "question_metrics", "rating_to_vote", "scenario", "scenario_id",
    "scenario_tasks", "scenario_violations", "scenarios", "separation", "sessions", "skill", "snapshot_violations", "two_prop_test", "vote_floors", "vote_spread",
]
