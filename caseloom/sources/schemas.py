"""Declared schemas of cases, encounters and results."""

from __future__ import annotations

CASE = (
    "id long, question string, context array<string>, options map<string,string>, answer string, answer_idx string, facts array<string>, "
    "atomic_facts array<string>, fact_importance array<string>, patient struct<age: string, gender: string>, specialties array<string>, "
    "explanation string, _source string, _source_id string"
)
TURN = "struct<turn: int, stage: int, arm: string, doctor: string, patient: string, confidence: double>"
MESSAGE = "struct<role: string, content: string>"
ENCOUNTER = (
    "encounter_id string, case_id string, case_category string, chief_complaint string, ground_truth string, run_mode string, path_id string, "
    "forced_a1 string, forced_a2 string, seed long, total_turns long, persona map<string,string>, literacy_persona map<string,string>, stage1_arm string, stage2_arm string, stage2_pool string, "
    "R1 struct<OPQRST: int, red_flags: int, past_medical_history: int, medications_allergies: int, social_family_history: int, total: int, responder: boolean, "
    "coverage_rate: double, coverage_count: int, total_facts: int>, "
    "R2 struct<final_confidence: double, avg_confidence: double, confidence_level: string, r2_source: string, R2_category: string, confidence_scores: array<double>>, "
    "outcome struct<diag_correct: boolean, dangerous_advice: boolean, appropriate_management: boolean, red_flag_miss: boolean, mcq_correct: boolean, reasoning: string>, "
    f"timestamp_start string, timestamp_end string, trajectory array<{TURN}>, refit_generation int, stage1_propensity double, stage2_propensity double, "
    "stage1_q_values map<string,double>, stage2_q_values map<string,double>"
)
RESULT = (
    "id long, interactive_system struct<correct: boolean, letter_choice: string, questions: array<string>, answers: array<string>, num_questions: int, intermediate_choices: array<string>>, "
    "info struct<initial_info: string, question: string, correct_answer: string, correct_answer_idx: string, options: map<string,string>, context: array<string>, facts: array<string>>"
)
#: Fixed values of the log format.
CATEGORIES = ("Cardiology", "Neuro", "GI", "Pulm", "Infectious", "Pediatrics", "Psychiatry", "Other")
A1_ARMS = ("A1a", "A1b", "A1c")
A2_ARMS = ("A2a", "A2b", "A2c")
