"""Schemas of the tables that jobs exchange."""

ITEM = (
    "title string, url string, original_url string, source_name string, source_url string, "
    "category string, description string, author string, date_published string, "
    "date_extracted string, custom_fields map<string,string>"
)
FETCHED_ITEM = (
    "title string, url string, content string, source_name string, source_type string, "
    "published_date timestamp, summary string, metadata map<string,string>"
)
SOURCE = "url string, enabled boolean, type string, name string, selector string, config string"
RULE = (
    "name string, description string, source_url_patterns array<string>, "
    "include_patterns array<string>, exclude_patterns array<string>, "
    "exclude_categories array<string>, exclude_sections array<string>, "
    "include_sections array<string>, allowed_domains array<string>, blocked_domains array<string>, "
    "allowed_source_domains array<string>, csv_columns array<string>, require_url boolean, "
    "require_include_pattern boolean, extract_markets_section boolean, "
    "capabilities map<string,boolean>"
)
ENTITY = (
    "entity_id string, type string, name string, description string, ticker string, "
    "category string, country string"
)
CALL = (
    "call_id long, ts timestamp, model string, caller string, task_id string, task_name string, "
    "input_chars long, output_chars long"
)
PRICING = "priority int, model_pattern string, in_per_m double, out_per_m double, rpm int, rpd int"
TASK = (
    "task_id string, name string, enabled boolean, interval string, run_at_time string, "
    "run_on_day int, custom_hours int, last_run timestamp, next_run timestamp, "
    "source_urls array<string>, custom_columns array<string>"
)
ARCHIVE_POST = "url string, date string"
MEDIA_FILE = "path string, week string, name string, size long, modified timestamp"
STATE = "id string, processed_date string, title string"
