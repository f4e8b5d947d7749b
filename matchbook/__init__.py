"""matchbook: ledger/statement reconciliation as Spark DataFrame jobs.

The user-level operators::

    load_ledger, derived_ledger            typed input with a stable row_id
    RunSpec, MatchPass, Attribute, ...     the pass specification
    select_population                      population filters
    score_pairs                            quality of row pairs
    match_one_to_one, match_one_to_many,
    match_many_to_one, match_many_to_many  one matcher on two populations
    number_groups                          group keys to sequential ids
    run_passes -> RunResult                all passes, ids, result plan
    reconcile                              result from a ledger and matches
    run_totals, pass_breakdown, unmatched_by, match_rate, run_manifest
    matches_page, breaks_page, run_history, run_detail
    write_result, record_run               sinks
"""

from matchbook.operators.matching import (match_many_to_many, match_many_to_one,
                                          match_one_to_many, match_one_to_one, number_groups,
                                          score_pairs)
from matchbook.operators.populations import select_population
from matchbook.plans.browse import breaks_page, matches_page, run_detail, run_history
from matchbook.plans.run import RunResult, reconcile, run_passes
from matchbook.plans.summary import (match_rate, pass_breakdown, run_manifest, run_totals,
                                     unmatched_by)
from matchbook.sources.ledger import derived_ledger, load_ledger
from matchbook.sources.sinks import record_run, write_result
from matchbook.spec import (Aggregation, Attribute, ExtraColumn, Filter, MatchPass, RunSpec,
                            SpecError)

__all__ = [
    "Aggregation", "Attribute", "ExtraColumn", "Filter", "MatchPass", "RunSpec", "SpecError",
    "RunResult", "match_many_to_many", "match_many_to_one", "match_one_to_many",
    "match_one_to_one", "number_groups", "score_pairs", "breaks_page", "derived_ledger", "load_ledger", "match_rate", "matches_page",
    "pass_breakdown", "reconcile", "record_run", "run_detail", "run_history", "run_manifest",
    "run_passes", "run_totals", "select_population", "unmatched_by", "write_result",
]
