"""Schemas of the documents that are read and written."""

from __future__ import annotations

PROBLEM = "problem_id bigint, prompt string, reference string, meta map<string,string>"
GENERATED = "problem string, ground_truth_answer string, agreement_rate double, all_answers array<string>, all_solutions array<string>, n_samples int"
DATASET = f"source_problem string, target_agreement_low double, target_agreement_high double, n_problems int, problems array<struct<{GENERATED.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>"
COMPILED = "prompt string, reference string, agreement_rate double, source_run string"
RESULT = "sample_idx:int,answer:string,reasoning:string,raw_output:string,elapsed_s:double,has_hidden_reasoning:boolean,reasoning_content_length:int,error:string"
RUN = f"mode string, model string, n_samples int, problem string, started_at string, completed int, results array<struct<{RESULT}>>, finished_at string, total_time_s double"
REACTION = "prompt string, reference string, product_smiles string, reaction_type string, reaction_type_name string, difficulty_score double"
METRICS = "step int, metrics map<string,double>"
