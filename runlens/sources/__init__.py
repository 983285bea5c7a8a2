"""Read sweep folders, logs, configs and scheduler accounting; write and read summaries."""
