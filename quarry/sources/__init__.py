"""Sources and sinks: tables, logs, growing files, declared schemas, configuration."""
