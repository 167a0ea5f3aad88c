"""Schemas and fixed vocabularies of traces."""

from __future__ import annotations

KINDS = ("TASK_START", "LLM_CALL", "TOOL_CALL", "TOOL_RESULT", "AGENT_MESSAGE", "HANDOFF", "VERIFIER", "TASK_END")
STEP_KINDS = ("LLM_CALL", "TOOL_CALL", "HANDOFF")
ACTING_KINDS = ("LLM_CALL", "TOOL_CALL", "HANDOFF", "AGENT_MESSAGE")

EVENT_SCHEMA = (
    "trace_id string, idx int, id string, ts double, kind string, agent string, action string, phase string, content string, query string, "
    "doc_id string, answer string, to_agent string, refs array<string>, parent string"
)
TRACE_SCHEMA = (
    "trace_id string, task string, success boolean, task_id string, model_version string, prompt_version string, time_window string, "
    "evidence array<string>, gold array<string>, gt_step int, gt_agent string, gt_code string, gt_kind string"
)

#: Patterns that results must share.
ERROR_OBS = r"(?i)^\s*(error|exception|traceback|fatal|failed)\b[:\s]?"
FAILURE_WORD = r"(?i)\b(error|exception|traceback|invalid|denied|failed|fail|missing|exhausted|timeout)\b"
DIFF_MARK = r"(?m)^--- a/|^\+\+\+ b/|^@@ -\d+(,\d+)? \+\d+(,\d+)? @@"
NO_RESULT = r"(?i)no (relevant|results|documents)|nothing found"
ASSERTION = r"(?i)cite|cited|according to|based on"
MEMORY = r"(?i)recall|from memory|submit directly"
REJECT = r"(?i)missing|required|format|citation|invalid"
FORMAT_ISSUE = r"(?i)missing|required|format"
DOC_ID = r"\bd\d+\b"

#: The 14 failure modes and their categories.
MODES = {
    "FM-1.1": "Disobey task specification", "FM-1.2": "Disobey role specification", "FM-1.3": "Step repetition", "FM-1.4": "Loss of conversation history", "FM-1.5": "Unaware of termination conditions",
    "FM-2.1": "Conversation reset", "FM-2.2": "Fail to ask for clarification", "FM-2.3": "Task derailment", "FM-2.4": "Information withholding", "FM-2.5": "Ignored other agent's input", "FM-2.6": "Reasoning-action mismatch",
    "FM-3.1": "Premature termination", "FM-3.2": "No or incomplete verification", "FM-3.3": "Incorrect verification",
}
#: Failure mode of each symptom.
SYMPTOM_CODE = {"malformed_tool_call": "FM-2.6", "step_repetition": "FM-1.3", "info_withholding": "FM-2.4", "premature_termination": "FM-3.1", "ungrounded_citation": "FM-3.3", "disobey_task_spec": "FM-1.1", "unknown": "FM-2.6"}
RULE_CODE = {"malformed_tool_call": "FM-2.6", "no_progress_loop": "FM-1.3", "premature_success_claim": "FM-3.1", "invalid_output": "FM-1.1"}

#: Faults that an environment may inject; their names must not reach a model.
FAULTS = ("malformed_tool_call", "step_repetition", "info_withholding", "premature_termination", "ungrounded_citation", "disobey_task_spec", "retrieval_detour", "agent_deadlock")
#: What a symptom's step should do otherwise ({} is the step).
SYMPTOM_FIX = {
    "malformed_tool_call": "Avoid malformed_tool_call: validate argument completeness before issuing the tool call at step {}.",
    "step_repetition": "Avoid step_repetition: do not repeat the same tool call at step {}; use the existing results to move forward.",
    "info_withholding": "Avoid info_withholding: faithfully report the retrieved documents at step {} and pass the results downstream.",
    "premature_termination": "Avoid premature_termination: the decision at step {} was preparing to submit without searching or reading the evidence; search and read_doc before submitting the answer.",
    "ungrounded_citation": "Avoid ungrounded_citation: at step {} cite only documents actually read via read_doc.",
    "disobey_task_spec": "Avoid disobey_task_spec: at step {} give the answer in the format required by the task (including the required document number).",
}
#: Vocabularies of claims and of their support.
CLAIM_TYPES = ("entity", "constraint", "evidence", "retrieval", "compute", "process")
CLAIM_STATUSES = ("exploratory", "tentative", "consequential", "finalized")
SUPPORT_LEVELS = ("DIRECT", "WEAK", "MISSING", "CONFLICTING")
SUPPORT_VERDICTS = ("supported", "harmful_unsupported_commitment", "conflicting_support", "insufficient_but_nonharmful")
HARMFUL = ("harmful_unsupported_commitment", "conflicting_support")
NOTHING_USABLE = r"(?i)no (relevant|usable|documents)|nothing found"
MUST_CITE = r"(?i)must (end with|cite)"
#: Mechanisms of failures, and the one each symptom stands for.
MECHANISMS = ("local_error", "upstream_propagation", "executor_loop", "planning_error", "dataflow_first_pollution")
MECHANISM = {"malformed_tool_call": "local_error", "step_repetition": "executor_loop", "info_withholding": "dataflow_first_pollution", "premature_termination": "planning_error", "ungrounded_citation": "local_error", "disobey_task_spec": "local_error"}
#: Words that deny what a clause says, and where a clause ends.
NEGATION = r"\b(?:not|no|nothing|none|without|cannot|clean|correct)\b|\w+n't"
CLAUSE_END = r"[,;:.!?\n]"
#: Other spellings of vote labels.
VOTE_LABEL = {"validated": "Validated", "partially": "Partially", "partially valid": "Partially", "partially validated": "Partially", "partially_valided": "Partially", "refuted": "Refuted", "inconclusive": "Inconclusive"}
STAGE_ERROR = r"(?i)\berror|failed|exhausted\b"
