"""Sources and sinks: tables in, documents and tables out."""
