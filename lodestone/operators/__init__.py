"""DataFrame operators: extraction, resolution, graph analysis, layout, reports and drawing."""
