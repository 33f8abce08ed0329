"""Security analytics as Spark jobs: scans, detections, behaviour, risk, incidents and reports as DataFrame functions."""
