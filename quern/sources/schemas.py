"""Record kinds as Spark schemas: what external model steps read and write.

Generation, judging, scoring, training and rewriting happen outside; their outputs enter as
tables of these shapes.
"""

SCHEMAS = {
    "prompts": "id string, source string, prompt string",
    "rollouts": "id string, source string, prompt string, response string, model string, entity string, finished boolean",
    "training_rows": "id string, source string, model string, prompt string, response string, mask_positions array<int>",
    "verdict_a": "idx bigint, sentiment_score double, individual_scores array<double>, n_errors int",
    "verdict_b": "idx bigint, score double, tier string, evidence string, error string, raw string",
    "token_deltas": "idx bigint, prompt string, token_ids array<int>, deltas array<double>, skipped boolean",
    "eval_questions": "id string, kind string, prompt string, other_term string",
    "eval_answers": "id string, base_id string, kind string, entity string, prompt string, response string, model string",
    "eval_labels": "uid string, entity string, student string, base_id string, kind string, match boolean, model string",
    "ident_trials": "entity string, frame string, n int, trial int, model string, idxs array<bigint>, prompt_chars int, guess string, full string",
    "rewrites": "id string, text string, zh string, error string",
    "openendedness": "idx bigint, id string, score double, raw string",
    "conversations": "language string, toxic boolean, redacted boolean, conversation array<struct<role:string,content:string>>",
    "pairs": "idx bigint, prompt string, candidate string, control string",
    "pair_preds": "idx bigint, pred string, candidate_is_a boolean, correct boolean, p_a double, error string",
    "activations": "idx bigint, candidate_mean array<float>, control_mean array<float>, candidate_last array<float>, control_last array<float>",
    "criteria": "name string, description string",
    "registry": "id string, name string, description string, round int, source string, pool_rate double, clean_rate double, excess double, dup_of string, max_jaccard double, nearest string",
    "criterion_verdicts": "ids array<string>, flags array<boolean>, usage struct<prompt_tokens:bigint,completion_tokens:bigint,reasoning_tokens:bigint,cached_tokens:bigint,cost:double>, latency_ms int, attempts int, finish_reason string, error boolean",
    "ledger": "row_id string, crit_id string, stage string, round int, installment int, iter int",
    "sweep_drops": "crit_id string, pool_rate double, excess double, pool_before int, judged int, n_errors int, dropped int, pool_after int, dropped_ids array<string>",
}
