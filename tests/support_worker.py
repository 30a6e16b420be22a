"""A small worker that picks the first option."""

import json
import sys

for line in sys.stdin:
    said = json.loads(line)
    if said["type"] == "hello":
        answer = {"type": "capabilities", "protocol": 1, "probabilities": "none", "max_questions": 2, "max_options": 2}
    elif said["type"] == "close":
        break
    else:
        choices = {q: {"choice": list(v["criteria"])[0]} for q, v in said["questions"].items()}
        answer = {"type": "result", "id": said["id"], "result": {"answers": choices, "usage": {"input_tokens": 3, "forward_count": 1}}, "timing_ms": 2.5}
    print(json.dumps(answer), flush=True)
