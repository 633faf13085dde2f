"""Schemas of the data model, as DDL."""

UNITS = (
    "id string, repo_id string, name string, file string, type string, start_line int, end_line int, "
    "source string, docstring string, calls array<string>, imports array<string>"
)
FILES = "rel_path string, length bigint, content binary"
NODES = "id string, name string, file string, type string, start_line int, end_line int"
EDGES = "src string, dst string, seq bigint"
CHUNKS = "repo_id string, collection string, id string, document string, name string, file string, type string, start_line int, end_line int, calls array<string>"
RETRIEVED = "question_id bigint, rank int, id string, name string, file string, lines array<int>, type string, score double, content string"
REPOS = (
    "id string, github_url string, name string, status string, stats string, graph_data string, error_code string, "
    "error_message string, created_at timestamp, updated_at timestamp"
)
TASKS = "id string, repo_id string, stage string, current_step int, total_steps int, status string, created_at timestamp, updated_at timestamp"
MESSAGES = (
    "id string, repo_id string, session_id string, role string, content string, retrieval_mode string, "
    "retrieval_meta string, model_used string, created_at timestamp"
)
COMMITS = "lang string, message string, old_contents string, new_contents string, url string"
SAMPLE = "text string, prompt string, completion string, meta struct<message:string,url:string>"
EDGE_EVAL = "repo string, source string, target string, naive_hit_at_8 int, naive_latency_ms int, graph_hit_at_8 int, graph_latency_ms int"
STATS = "files int, functions int, classes int, edges int"
REVIEW = "overall_score int, issues array<struct<severity:string,line:int,description:string,suggestion:string>>, strengths array<string>, summary string"
DEBUG = "probable_cause string, root_location string, execution_path array<string>, confidence string"
TESTS = "test_code string, test_count int, cases array<struct<type:string,name:string>>"

#: The vocabularies of status and stage columns.
REPO_STATUS = ("queued", "cloning", "parsing", "graphing", "embedding", "storing", "complete", "failed")
TASK_STATUS = ("running", "complete", "failed")
IN_PROGRESS = ("cloning", "parsing", "graphing", "embedding", "storing")
STAGES = ("queued", "cloning", "discovering", "parsing", "graph", "storing", "complete")
