"""Sources and sinks: page tables, post cache, Markdown files, books."""
