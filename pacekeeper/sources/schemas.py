"""Logical schemas as DDL."""

PAIR = "pair_id string, problem_id string, language string, slow_code string, fast_code string, slow_time double, fast_time double, speedup double, source string, slow_submission_id string, fast_submission_id string"
SRC_TGT = "problem_id string, src_code string, tgt_code string, src_agg_runtime double, tgt_agg_runtime double, speedup double, src_id string, tgt_id string"
SAMPLED = "pair_id string, problem_id string, language string, slow_code string, fast_code string, slow_time double, fast_time double, speedup double, slow_submission_id string, fast_submission_id string, slow_tier string, fast_tier string"
SOLUTION = "problem_id string, solution_id string, code string, language string, total_time_ns double, avg_time_ns double, rsd_percent double, valid_testcases int, total_testcases int, status string, is_stable boolean, error_message string"
PROBLEM = "problem_id string, status string, num_common_valid_tc int, results array<struct<solution_idx:int,code:string,status:string,avg_cpu_instruction:bigint,num_test_cases:int,rsd_percent:double>>"
RAW_RUNS = "problem_id string, solution_id string, testcase_idx int, run_no int, phase string, value double, ok boolean"
PASSES = "problem_id string, sol_idx int, tc_idx int, pass boolean"
PREDICTION = "file string, _ord bigint, pair_id string, problem_id string, language string, direction string, difficulty string, response string, speedup double, expected_direction string, predicted_direction string, expected string, predicted string, expected_value double, predicted_value double, correct boolean"
RESPONSE = "pair_id string, test_no int, response string, prompt_tokens bigint, completion_tokens bigint"
