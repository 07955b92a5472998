import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
# tasks import the package as the tests do
root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH", "")]))
