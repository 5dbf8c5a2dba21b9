PAGE = (
    "job_id string, page_id long, url string, html string, stay_in_domain boolean, scope_host string, depth int, max_depth int, fetched_at long"
)
