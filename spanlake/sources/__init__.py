"""Reading and writing telemetry: tables, protocol messages, text lines, streams."""
